"""Fingerprints, redaction and normalised text, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below so many bytes a hash would tell the content.
LEAST_BYTES = 16

_KEY_NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|authorization|credential"

#: Name, pattern, replacement, in the order in which they apply. Behind the seven kinds of credentials
#: stand two of our own, keys of other prefixes and e-mail. What stands before a name stays as it is, so the
#: field pattern does not have to read it.
SECRETS = (
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|(?=\n?\z))", "[REDACTED:private-key]"),
    ("bearer", r"(?iU)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED:bearer]"),
    ("aws-key", r"(?U)\b(?:AKIA|ASIA)[0-9A-Z]{12,}\b", "[REDACTED:aws-key]"),
    ("github-token", r"(?U)\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b", "[REDACTED:github-token]"),
    ("slack-token", r"(?U)\bxox[abprs]-[A-Za-z0-9-]{8,}\b", "[REDACTED:slack-token]"),
    ("api-key", r"(?U)\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED:api-key]"),
    ("secret-field", rf"(?iU)((?:{_KEY_NAMES})[A-Za-z0-9_-]*+[\"']?\s*[:=]\s*[\"']?)(?!\[REDACTED)[^\"'\s,;&}}\]]+", "$1[REDACTED]"),
    ("key", r"\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{8,}", "[key]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
)

#: What every text has that one of SECRETS changes.
_HINTS = rf"(?iU)@|-----BEGIN|bearer|AKIA|ASIA|gh[pousr]_|ghp-|github_pat_|xox|[sp]k[-_]|{_KEY_NAMES}"


def fingerprint(column: str | Column) -> Column:
    """sha256 in hex; null for short content."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.octet_length(column) >= LEAST_BYTES, F.sha2(column, 256))


def value_hash(variant: Column) -> Column:
    """sha256 of a value in canonical JSON, in which a string and what it spells differ; null where that is short,
    as for empty values."""
    text = F.to_json(variant)
    return F.when(F.octet_length(text) >= LEAST_BYTES, F.sha2(text, 256))


def redacted(column: str | Column, length: int = 200) -> Column:
    """Secrets replaced first, cut to length after. Texts without any beginning of one go by all patterns."""
    column = F.col(column) if isinstance(column, str) else column
    found = column
    for _, pattern, stand_in in SECRETS:
        found = F.regexp_replace(found, pattern, stand_in)
    return F.substring(F.when(column.rlike(_HINTS), found).otherwise(column), 1, length)


def name_id(column: str | Column) -> Column:
    """The id of an app's project: md5 of its trimmed lower-case name, in the form of a UUID of version 4."""
    name = F.regexp_replace(F.col(column) if isinstance(column, str) else column, "^ +| +$", "")
    digest = F.md5(F.concat(F.lit("app-project-name:"), F.lower(name)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def json_value(column: str | Column) -> Column:
    """A scalar as JSON; null as null."""
    column = F.col(column) if isinstance(column, str) else column
    listed = F.to_json(F.array(column))
    return F.when(column.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def json_array(*columns: str | Column) -> Column:
    """A JSON array as a database prints it: with a blank behind each comma."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[json_value(c) for c in columns]), F.lit("]"))


def canonical_json(column: str | Column, without: tuple[str, ...] = ()) -> Column:
    """JSON text with sorted keys and no blanks; arrays keep their order, `without` names keys of the top
    that are left out; null where it is no JSON."""
    column = F.col(column) if isinstance(column, str) else column
    held = F.to_json(F.try_parse_json(column))
    if not without:
        return held
    entries = F.map_filter(F.from_json(held, "map<string,string>"), lambda k, v: ~k.isin(*without))
    raw = lambda k: F.to_json(F.try_variant_get(F.try_parse_json(held), F.concat(F.lit("$['"), k, F.lit("']")), "variant"))
    listed = F.transform(F.array_sort(F.map_keys(entries)), lambda k: F.concat(json_value(k), F.lit(":"), F.coalesce(raw(k), F.lit("null"))))
    return F.when(held.isNotNull(), F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")))


def content_hash(column: str | Column) -> Column:
    """sha256 of canonical JSON."""
    return F.sha2(canonical_json(column), 256)


#: Key names under which a long opaque string counts as a credential.
SENSITIVE_KEY = "(?i)token|secret|key|password|passwd|credential"


def looks_secret(key: str | Column, value: str | Column, least: int = 16) -> Column:
    """Whether a value under a key reads as a credential: long, without blanks, and no path."""
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    path = value.rlike(r"^(?:~|\.{1,2})?[/\\]") | value.rlike(r"^[A-Za-z]:[/\\]")
    return F.coalesce(key.rlike(SENSITIVE_KEY) & (F.octet_length(value) >= least) & ~value.rlike(r"\s") & ~path, F.lit(False))


def short_hash(column: str | Column) -> Column:
    """The first seven characters of a commit; empty for none."""
    return F.substring(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), 1, 7)


def same_commit(a: Column, b: Column) -> Column:
    """Whether one is the beginning of the other; neither may be missing or empty."""
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, b) | F.startswith(b, a)), F.lit(False))


def shown_name(name: Column, label: Column, kind: Column) -> Column:
    """A tool's name as it reads: its label, else its own, hashed ones cut short, else that it is built in."""
    hashed = name.rlike("^h:[a-f0-9]{16}$")
    return F.coalesce(label, F.when(hashed, F.concat(F.substring(name, 1, 6), F.lit("\u2026"))).otherwise(name), F.when(kind == "builtin", "builtin (unnamed)"))


def shown_namespace(space: Column, label: Column, prefix: str = "codex_apps:") -> Column:
    """A namespace as it reads: a connector by its app, a hash without a label cut short."""
    told = F.coalesce(label, space)
    connector = F.startswith(told, F.lit(prefix)) & (F.length(told) > len(prefix))
    return F.when(connector, F.concat(F.substring(told, F.lit(len(prefix) + 1), F.length(told)), F.lit(" (connector)"))).when(label.isNull() & space.rlike("^h:[a-f0-9]{16}$"), F.concat(F.substring(space, 1, 6), F.lit("\u2026"))).otherwise(told)


_PART = r"(?i)\s*\((?:\d+\s*/\s*\d+|cont(?:inued|'d|\.)?)\)\s*$"


def base_title(column: str | Column) -> Column:
    """A title without a colon at its end and without the mark of a split copy, such as (2/3)."""
    column = F.col(column) if isinstance(column, str) else column
    colon = lambda c: F.regexp_replace(c, r":\s*$", "")
    return F.trim(colon(F.regexp_replace(colon(column), _PART, "")))


def normal_title(column: str | Column) -> Column:
    """A title to compare by: its base in lower case, one blank for what is neither letter nor number."""
    return F.trim(F.regexp_replace(F.lower(base_title(column)), r"[^\p{L}\p{N}]+", " "))


def model_name(column: str | Column, *, dated: bool = True) -> Column:
    """A model's name to look up by: trimmed, lower case, and without a date at its end unless `dated`."""
    name = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return name if dated else F.regexp_replace(name, r"-\d{8}$", "")


def normal_path(column: str | Column, *, home: Column | None = None, base: Column | None = None) -> Column:
    """An absolute path with `/`, without `.`, `..` and a separator at its end; Windows forms in lower case.

    `~/` stands for home and a relative path lies below base, which are normal themselves. Null for what
    can't be told: URLs, variables, other users' homes, a relative path without base."""
    value = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.col(column) if isinstance(column, str) else column), r"""^["'](.*)["']$""", "$1")), r"\\", "/")
    nothing = F.lit(None).cast("string")
    below = lambda root, rest: F.concat(root, F.lit("/"), rest) if root is not None else nothing
    windows = value.rlike("^[A-Za-z]:/")
    whole = (
        F.when((value == "") | value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+://") | value.rlike(r"[$%]"), nothing)
        .when(value.rlike("^~(?:/|$)"), below(home, F.substring(value, F.lit(3), F.length(value))))
        .when(F.startswith(value, F.lit("~")), nothing)
        .when(windows | F.startswith(value, F.lit("/")), value)
        .otherwise(below(base, value))
    )
    drive = F.regexp_extract(whole, "^[A-Za-z]:", 0)
    parts = F.filter(F.split(F.substring(whole, F.length(drive) + 1, F.length(whole)), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, p)))
    joined = F.concat(drive, F.lit("/"), F.array_join(kept, "/"))
    return F.when(drive != "", F.lower(joined)).otherwise(joined)


def diff_lines(patch: str | Column) -> Column:
    """The lines that a patch adds or removes, without its file headers and places."""
    lines = F.split(F.col(patch) if isinstance(patch, str) else patch, "\n")
    return F.array_join(F.filter(lines, lambda x: x.rlike(r"^[+-]") & ~F.startswith(x, F.lit("+++")) & ~F.startswith(x, F.lit("---"))), "\n")


def display(column: str | Column, length: int = 120) -> Column:
    """Without control, format and line-separator characters, trimmed and cut in code points."""
    column = F.col(column) if isinstance(column, str) else column
    return F.substring(F.trim(F.regexp_replace(column, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", "")), 1, length)


def excerpt(column: str | Column, length: int = 160) -> Column:
    """Text of marked-up content: comments and tags out, white space collapsed."""
    column = F.col(column) if isinstance(column, str) else column
    plain = F.regexp_replace(F.regexp_replace(column, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"[ \t\n\r]+", " ")), 1, length)
