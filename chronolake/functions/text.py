"""Column functions over names, paths, messages and identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in their natural order: languages by file extension (lower case, without the dot).
LANGUAGES = {
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "py": "Python", "pyi": "Python", "pyw": "Python", "pyx": "Python", "rs": "Rust", "go": "Go",
    "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "scala": "Scala", "groovy": "Groovy", "clj": "Clojure", "cljs": "ClojureScript", "cljc": "Clojure",
    "c": "C", "h": "C", "cpp": "C++", "cxx": "C++", "cc": "C++", "hpp": "C++", "hxx": "C++", "cs": "C#", "rb": "Ruby", "erb": "ERB", "php": "PHP", "swift": "Swift", "m": "Objective-C", "mm": "Objective-C++",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "fish": "Fish", "ps1": "PowerShell", "psm1": "PowerShell",
    "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "SCSS", "sass": "Sass", "less": "Less", "styl": "Stylus", "vue": "Vue", "svelte": "Svelte",
    "json": "JSON", "jsonc": "JSON", "json5": "JSON5", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "xml": "XML", "xsl": "XML", "csv": "CSV", "tsv": "TSV", "ini": "INI", "env": "dotenv",
    "md": "Markdown", "mdx": "MDX", "rst": "reStructuredText", "tex": "LaTeX", "adoc": "AsciiDoc", "sql": "SQL", "prisma": "Prisma",
    "hs": "Haskell", "lhs": "Haskell", "ml": "OCaml", "mli": "OCaml", "fs": "F#", "fsx": "F#", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "hrl": "Erlang", "elm": "Elm",
    "zig": "Zig", "nim": "Nim", "v": "V", "d": "D", "asm": "Assembly", "s": "Assembly", "wasm": "WebAssembly", "wat": "WebAssembly",
    "lua": "Lua", "r": "R", "jl": "Julia", "pl": "Perl", "pm": "Perl", "dart": "Dart", "tcl": "Tcl", "tf": "Terraform", "hcl": "HCL", "nix": "Nix",
    "proto": "Protocol Buffers", "graphql": "GraphQL", "gql": "GraphQL", "thrift": "Thrift", "avsc": "Avro", "sol": "Solidity", "wgsl": "WGSL", "glsl": "GLSL", "hlsl": "HLSL", "cmake": "CMake",
}
#: Fixed values, in their natural order: languages by the name of a dotfile (lower case, without the first dot).
DOTFILES = {
    "bashrc": "Shell", "bash_profile": "Shell", "bash_login": "Shell", "bash_logout": "Shell", "bash_aliases": "Shell", "profile": "Shell", "zshrc": "Shell", "zshenv": "Shell", "zprofile": "Shell", "zlogin": "Shell",
    "zlogout": "Shell", "zsh_aliases": "Shell", "kshrc": "Shell", "cshrc": "Shell", "tcshrc": "Shell", "shrc": "Shell",
    "gitignore": "gitignore", "gitattributes": "gitattributes", "gitmodules": "gitconfig", "gitconfig": "gitconfig",
    "editorconfig": "EditorConfig", "vimrc": "Vim Script", "gvimrc": "Vim Script", "exrc": "Vim Script", "nvimrc": "Vim Script", "nanorc": "nanorc", "inputrc": "Readline",
    "eslintrc": "JSON", "prettierrc": "JSON", "stylelintrc": "JSON", "babelrc": "JSON", "browserslistrc": "Browserslist", "markdownlintrc": "JSON",
    "env": "dotenv", "envrc": "Shell", "npmrc": "INI", "yarnrc": "YAML", "nvmrc": "Text", "node_version": "Text", "ruby_version": "Text", "python_version": "Text", "tool_versions": "Text",
    "dockerignore": "dockerignore", "travis": "YAML",
    "htaccess": "Apache Config", "htpasswd": "Apache Config", "mailmap": "mailmap", "clang_format": "YAML", "clang_tidy": "YAML", "flake8": "INI", "pylintrc": "INI", "perlcriticrc": "INI", "rubocop": "YAML", "rspec": "Ruby",
    "gemrc": "YAML", "irbrc": "Ruby", "pryrc": "Ruby",
}
#: Fixed values, in their natural order: names for syntax highlighting by extension; plaintext for others.
HIGHLIGHTERS = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx", ".json": "json", ".css": "css", ".scss": "scss", ".less": "less", ".html": "html", ".xml": "xml", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml",
    ".py": "python", ".rs": "rust", ".go": "go", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "fish", ".sql": "sql",
    ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".vue": "vue", ".svelte": "svelte",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The part from the last dot of the last segment, dot included; null without one."""
    return F.nullif(F.regexp_extract(path, r"(\.[^./]*)$", 1), F.lit(""))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def language(path: Column) -> Column:
    """By the extension in lower case, else by the name of a dotfile; null if unknown.  A name's first character begins no extension."""
    name = base_name(path)
    rest = F.regexp_replace(name, r"^\.", "")
    known = _lookup(LANGUAGES, F.lower(F.regexp_extract(rest, r"(?s)^.+\.([^.]*)$", 1)))
    return F.coalesce(known, F.when(name.startswith("."), _lookup(DOTFILES, F.lower(rest))))


def highlighter(path: Column) -> Column:
    """The name of a highlighter by the extension; plaintext for others and for dotfiles."""
    return F.coalesce(_lookup(HIGHLIGHTERS, F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)$", 1))), F.lit("plaintext"))


def subject(message: Column) -> Column:
    return F.trim(F.split(message, "\n")[0])


def body(message: Column) -> Column:
    return F.trim(F.regexp_extract(message, r"^[^\n]*\n([\s\S]*)$", 1))


def short_ref(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads|tags|remotes|notes)/", "")


def ref_kind(name: Column) -> Column:
    return (
        F.when(name == "HEAD", "head").when(name.startswith("refs/heads/"), "branch").when(name.startswith("refs/tags/"), "tag").when(name.startswith("refs/remotes/"), "remote")
        .when(name.startswith("refs/notes/"), "notes").when(name == "refs/stash", "stash").otherwise("other")
    )


def namespace(source: Column, full_name: Column) -> Column:
    return F.concat_ws(":", source, full_name)


def namespace_source(name: Column) -> Column:
    """The part before the first colon; github without one."""
    return F.when(F.instr(name, ":") > 0, F.substring_index(name, ":", 1)).otherwise("github")


def namespace_path(name: Column) -> Column:
    return F.when(F.instr(name, ":") > 0, F.regexp_replace(name, "^[^:]*:", "")).otherwise(name)


def identity(line: Column) -> Column:
    """name, email, seconds and zone of `Name <email> seconds zone`; nulls for other lines."""
    form = r"^(.*) <([^>]*)> (\d+) ([+-]\d{4})$"
    part = lambda i: F.when(line.rlike(form), F.regexp_extract(line, form, i))
    return F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("long").alias("seconds"), part(4).alias("zone"))


def object_id(kind: str, raw: Column) -> Column:
    """Content address: SHA-1 of kind, size and bytes."""
    header = F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(raw).cast("string")), "UTF-8")
    return F.sha1(F.concat(header, F.unhex(F.lit("00")), raw))


def is_sha(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{40}$")


def valid_ref_name(name: Column) -> Column:
    """No empty, dotted or .lock component, no .., @{, control or special character, and no / or . at the end."""
    bad = r"(^$|^@$|^/|/$|//|\.\.|@\{|\.$|[\x00-\x20~^:?*\[\\\x7f]|(^|/)\.|\.lock(/|$))"
    return name.isNotNull() & ~name.rlike(bad)


def valid_branch_name(name: Column) -> Column:
    """A short name: at most 255 characters, no - first, no .lock, / or . last, no .., //, @, space, control or special character, not HEAD and not below refs/."""
    bad = r"^$|^-|\.lock$|[/.]$|\.\.|//|@|^HEAD$|^refs/|[\s~^:\\?*\[\x00-\x1f\x7f]"
    return F.coalesce((F.length(name) <= 255) & ~name.rlike(bad), F.lit(False))


def valid_tag_name(name: Column) -> Column:
    return F.coalesce((name != "") & ~name.startswith("refs/") & valid_ref_name(F.concat(F.lit("refs/tags/"), name)), F.lit(False))


def valid_remote_name(name: Column) -> Column:
    return F.coalesce((name != "") & ~name.contains("/") & valid_ref_name(F.concat(F.lit("refs/remotes/"), name)), F.lit(False))


#: Kinds by mode.
MODES = {"100644": "file", "100755": "executable", "040000": "directory", "40000": "directory", "120000": "symlink", "160000": "submodule"}


def mode_kind(mode: Column) -> Column:
    """file, executable, directory, symlink or submodule; null for other modes."""
    return _lookup(MODES, mode)


def significant_mode_change(old: Column, new: Column) -> Column:
    """Whether a file, link or submodule became one of the others; an execute bit doesn't count."""
    plain = lambda m: F.when(mode_kind(m) == "executable", "file").otherwise(mode_kind(m))
    kinds = ("file", "symlink", "submodule")
    return F.coalesce((plain(old) != plain(new)) & plain(old).isin(*kinds) & plain(new).isin(*kinds), F.lit(False))


#: First bytes of image files.
SIGNATURES = ["89504E47", "FFD8FF", "47494638"]


def has_signature(raw: Column) -> Column:
    out = F.lit(False)
    for s in SIGNATURES:
        out = out | F.startswith(raw, F.unhex(F.lit(s)))
    return F.coalesce(out, F.lit(False))


def fnv1a(text: Column, seed: int = 2166136261) -> Column:
    """The 32-bit FNV-1a hash of a text's characters, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hexadecimal HMAC-SHA-256 of a binary column."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def object_path(location: Column, prefix: str | None = None) -> Column:
    """The path of a location without its scheme and bucket, below prefix."""
    path = F.regexp_replace(location, "^[a-z0-9]+://[^/]+/", "")
    return F.concat(F.lit(f"{prefix}/"), path) if prefix else path


def sparse_prune(folder: Column, patterns: list[str]) -> Column:
    """Whether a folder may hold paths that sparse patterns take in: one fits a path in it, or names it or a place beneath."""
    out = F.lit(False)
    for p in patterns:
        if p.startswith("!"):
            continue
        fixed = p.lstrip("/").rstrip("/")
        out = out | sparse_match(F.concat(folder, F.lit("/x")), [p]) | F.startswith(F.lit(fixed), F.concat(folder, F.lit("/"))) | (folder == fixed)
    return out


def is_binary(raw: Column) -> Column:
    return F.coalesce(F.contains(F.substring(raw, 1, 8000), F.unhex(F.lit("00"))), F.lit(False))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a path glob: ** any text, * and ? within a segment, {a,b} alternatives."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def ref_glob_regex(pattern: str) -> str:
    """Anchored regular expression of a name glob, in which * crosses slashes."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def path_specs(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Any include (all if none) and no exclude."""
    out = F.lit(not include)
    for p in include:
        out = out | path.rlike(glob_regex(p))
    for p in exclude:
        out = out & ~path.rlike(glob_regex(p))
    return out


def name_patterns(name: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Any include (all if none) and no exclude, as name globs in which * crosses slashes."""
    out = F.lit(not include)
    for p in include:
        out = out | name.rlike(ref_glob_regex(p))
    for p in exclude:
        out = out & ~name.rlike(ref_glob_regex(p))
    return out


def sparse_match(path: Column, patterns: list[str]) -> Column:
    """Ordered patterns, of which the last that fits decides: ! negates, a leading / anchors, a trailing / means beneath."""
    out = F.lit(False)
    for p in patterns:
        negated, p = p.startswith("!"), p.lstrip("!")
        anchored, beneath, p = p.startswith("/"), p.endswith("/"), p.strip("/")
        inner = glob_regex(p)[1:-1]
        out = F.when(path.rlike(f"{'^' if anchored else '(^|/)'}{inner}{'/' if beneath else '(/|$)'}"), F.lit(not negated)).otherwise(out)
    return out


def version_key(name: Column) -> Column:
    """Numbers of a version name as an array that compares in order; v is dropped, missing parts count 0, parts may have 38 digits."""
    zero = F.lit(0).cast("decimal(38,0)")
    parts = F.transform(F.split(F.regexp_replace(name, "^v", ""), r"[.\-]"), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), zero))
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != zero, i + 1).otherwise(0)))  # zeros at the end are as if missing
    return F.slice(parts, F.lit(1), last)


def positional_similarity(a: Column, b: Column) -> Column:
    """Percentage of equal characters at equal places, of the longer text; 100 if both are empty, 0 if one is missing."""
    longer = F.greatest(F.length(a), F.length(b))
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() | b.isNull(), 0).when(longer == 0, 100).otherwise(F.floor(100 * equal / longer + 0.5)).cast("int")


def _window_hashes(text: Column) -> Column:
    """A hash of every four characters in a row: their codes as digits to the base 31."""
    code = lambda i: F.ascii(F.substr(text, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(text) - 3), lambda i: code(i) * 29791 + code(i + 1) * 961 + code(i + 2) * 31 + code(i + 3))


def block_similarity(a: Column, b: Column) -> Column:
    """Share of the windows of four characters of b that a has, of the longer's; of shorter texts the share of equal places; 0 if one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    known = F.array_distinct(_window_hashes(a))
    hits = F.size(F.filter(_window_hashes(b), lambda h: F.array_contains(known, h)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(F.least(F.length(a), F.length(b)) < 4, equal / longer).otherwise(hits / (longer - 3))
