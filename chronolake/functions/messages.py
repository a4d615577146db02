"""Column functions over the text of commits, tags and pointers, and over messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _held(value: Column, use) -> Column:
    """use(value), with value computed once: what is used in a branch more than once is else computed each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def commit_fields(raw: Column) -> Column:
    """tree, parents, author and committer identities, message of a commit's text; null without a tree line.

    Header lines end at the first blank line; milliseconds are whole seconds times 1000."""
    form = r" (.*) <([^>]*)> (\d+) ([+-]\d{4})$"

    def parsed(text: Column, header: Column, author: Column) -> Column:
        part = lambda i: F.regexp_extract(author, f"(?m)^author{form}", i)
        fields = F.struct(
            F.regexp_extract(header, "(?m)^tree ([0-9a-f]{40})$", 1).alias("tree"), F.regexp_extract_all(header, F.lit("(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
            part(1).alias("author_name"), part(2).alias("author_email"), (F.nullif(part(3), F.lit("")).cast("long") * 1000).alias("author_ms"),
            F.regexp_extract(header, f"(?m)^committer{form}", 1).alias("committer_name"), F.regexp_extract(text, r"\n\n([\s\S]*)$", 1).alias("message"), header.contains("\ngpgsig ").alias("is_signed"),
        )
        return F.when(header.rlike("(?m)^tree [0-9a-f]{40}$"), fields)

    authored = lambda text, header: _held(F.regexp_extract(header, f"(?m)^author{form}", 0), lambda author: parsed(text, header, author))
    return _held(raw, lambda text: _held(F.substring_index(text, "\n\n", 1), lambda header: authored(text, header)))


def commit_text(tree: Column, parents: Column, author: Column, committer: Column, message: Column) -> Column:
    """The text whose hash is a commit's id; author and committer are `Name <email> seconds zone`."""
    lines = F.concat(F.array(F.concat(F.lit("tree "), tree)), F.transform(parents, lambda p: F.concat(F.lit("parent "), p)), F.array(F.concat(F.lit("author "), author), F.concat(F.lit("committer "), committer)))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), message)


def lfs_pointer(raw: Column) -> Column:
    """oid and size of a large-file pointer; null for other texts."""
    ok = raw.startswith("version https://git-lfs.github.com/spec/v1") & raw.rlike("(?m)^oid sha256:[0-9a-f]{64}$") & raw.rlike(r"(?m)^size \d+$")
    return F.when(ok, F.struct(F.regexp_extract(raw, "(?m)^oid sha256:([0-9a-f]{64})$", 1).alias("oid"), F.regexp_extract(raw, r"(?m)^size (\d+)$", 1).cast("long").alias("size")))


def cleaned(message: Column, strip_comments: bool = True) -> Column:
    """Without comment lines, spaces at line ends, runs of blank lines, and blank lines at either end."""
    out = F.regexp_replace(message, "(?m)^#.*(\n|$)", "") if strip_comments else message
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\n+|\n+$", "")


def trailers(message: Column) -> Column:
    """`Key: value` lines of the last paragraph, if all of its lines are such, as an array of (key, value)."""
    last = F.element_at(F.split(F.regexp_replace(message, r"\n+$", ""), r"\n\n"), -1)
    lines = F.split(last, "\n")
    form = r"^([A-Za-z0-9-]+): (.*)$"
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, form, 1).alias("key"), F.regexp_extract(x, form, 2).alias("value")))
    return F.when(message.contains("\n\n") & F.forall(lines, lambda x: x.rlike(form)), pairs)


def valid_message(message: Column, subject_limit: int = 72) -> Column:
    """The first fault of a message, or ok: empty, a long subject, or no blank line after it."""
    lines = F.split(message, "\n")
    return F.when(F.trim(message) == "", "empty").when(F.length(lines[0]) > subject_limit, "long-subject").when((F.size(lines) > 1) & (F.get(lines, F.lit(1)) != ""), "no-blank-line").otherwise("ok")


def refspec(spec: str, name: Column) -> Column:
    """The destination of a ref name under `[+]source:destination`, each with a * at most; null if it doesn't fit."""
    source, _, target = spec.lstrip("+").partition(":")
    if "*" not in source:
        return F.when(name == source, F.lit(target))
    left, right = source.split("*", 1)
    middle = F.substr(name, F.lit(len(left) + 1), F.length(name) - len(left) - len(right))
    first, rest = target.split("*", 1)
    return F.when(name.startswith(left) & name.endswith(right) & (F.length(name) >= len(left) + len(right)), F.concat(F.lit(first), middle, F.lit(rest)))


def tree_order(name: Column, mode: Column) -> Column:
    """Sort key of a tree entry: directories compare as name and /."""
    return F.when(mode.isin("040000", "40000"), F.concat(name, F.lit("/"))).otherwise(name)


def lsn(ts: Column, counter: Column) -> Column:
    """A log sequence number: milliseconds in the upper 48 bits, a counter in the lower 16."""
    return F.shiftleft(F.unix_millis(ts.cast("timestamp")), 16).bitwiseOR(counter.bitwiseAND(65535))


def bloom_false_positive_rate(bits: Column, hashes: Column, items: Column) -> Column:
    return F.pow(1 - F.exp(-hashes * items / bits), hashes)


def back_off_ms(attempt: Column, first: int = 100, factor: float = 2.0, most: int = 5000) -> Column:
    return F.least(F.lit(float(most)), first * F.pow(F.lit(factor), attempt))


def commit_fault(raw: Column) -> Column:
    """The first part of a commit's text that is missing or malformed (tree, parent, author, committer), or ok."""
    header = F.regexp_extract(raw, r"^([\s\S]*?)(?:\n\n|$)", 1)
    person = lambda who: header.rlike(rf"(?m)^{who} [^\n]* <[^>\n]*> \d+ [+-]\d{{4}}$")
    bad_parent = header.rlike(r"(?m)^parent (?![0-9a-f]{40}$)")
    return F.when(~header.rlike("^tree [0-9a-f]{40}(?:\n|$)"), "tree").when(bad_parent, "parent").when(~person("author"), "author").when(~person("committer"), "committer").otherwise("ok")


def wrapped(message: Column, width: int = 72) -> Column:
    """The body's lines broken at spaces to width characters, where a word isn't longer; the subject stays."""
    lines = F.split(message, "\n")
    broken = lambda line: F.regexp_replace(F.regexp_replace(line, rf"(.{{1,{width}}})(?: +|$)", "$1\n"), "\n$", "")
    body = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.when(F.length(x) > width, broken(x)).otherwise(x))
    return F.array_join(F.concat(F.slice(lines, 1, 1), body), "\n")


def author_line(line: Column) -> Column:
    """name, email and milliseconds of `Name <email> seconds zone`, also without the zone; else empty, empty and 0."""
    form = r"^(.+) <(.+)> (\d+)"
    part = lambda i: F.regexp_extract(line, form, i)
    return F.struct(part(1).alias("name"), part(2).alias("email"), F.coalesce(F.nullif(part(3), F.lit("")).cast("long") * 1000, F.lit(0)).alias("ms"))


def signature(raw: Column) -> Column:
    """The signature in a commit's header, its lines joined without their leading space; null without one."""
    block = F.regexp_extract(raw, r"(?:^|\n)gpgsig ([^\n]*(?:\n [^\n]*)*)", 1)
    return F.nullif(F.regexp_replace(block, "\n ", "\n"), F.lit(""))


def signed(raw: Column, signature: Column) -> Column:
    """A commit's text with a signature after its header lines; as it is if that is null."""
    line = F.concat(F.lit("\ngpgsig "), F.regexp_replace(signature, "\n", "\n "), F.lit("\n\n"))
    at = F.instr(raw, "\n\n")
    return F.when(signature.isNull() | (at == 0), raw).otherwise(F.concat(F.substr(raw, F.lit(1), at - 1), line, F.substr(raw, at + 2)))


def tag_text(target: Column, kind: Column, name: Column, tagger: Column, message: Column) -> Column:
    """The text of an annotated tag; tagger is `Name <email> seconds zone`."""
    return F.concat(F.lit("object "), target, F.lit("\ntype "), kind, F.lit("\ntag "), name, F.lit("\ntagger "), tagger, F.lit("\n\n"), message)


def tag_fields(raw: Column) -> Column:
    """target, kind, name, tagger and message of a tag's text; null unless it begins with an object and a type that exists."""
    header = F.regexp_extract(raw, r"^([\s\S]*?)(?:\n\n|$)", 1)
    part = lambda who: F.regexp_extract(header, rf"(?m)^{who} (.*)$", 1)
    fields = F.struct(part("object").alias("target"), part("type").alias("kind"), part("tag").alias("name"), author_line(part("tagger")).alias("tagger"), F.regexp_extract(raw, r"\n\n([\s\S]*)$", 1).alias("message"))
    return F.when(header.rlike(r"^object [0-9a-f]{40}\ntype (blob|tree|commit|tag)\ntag \S"), fields)


def resource(name: Column) -> Column:
    """kind, left and right of what is asked for: `a..b` or `a...b` a diff, `ref:path` a file, else a commit."""
    diff, file = name.contains(".."), name.contains(":")
    left = F.when(diff, F.regexp_extract(name, r"^(.*?)\.\.", 1)).when(file, F.substring_index(name, ":", 1)).otherwise(name)
    right = F.when(diff, F.regexp_extract(name, r"^.*?\.\.\.?(.*?)(?:\.\.|$)", 1)).when(file, F.regexp_replace(name, "^[^:]*:", ""))
    return F.struct(F.when(diff, "diff").when(file, "file").otherwise("commit").alias("kind"), F.nullif(left, F.lit("")).alias("left"), F.nullif(right, F.lit("")).alias("right"))
