"""Column expressions for names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Lower-case words of two characters or more; camel case and acronym borders split."""
    apart = F.regexp_replace(col(c), "(?<=[^A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.regexp_extract_all(F.lower(apart), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)


def trigrams(c: Column | str) -> Column:
    """Distinct character triples of a string; none if it is shorter."""
    c = col(c)
    each = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))
    return F.when(F.length(c) < 3, F.array().cast("array<string>")).otherwise(each)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets given as arrays; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def idf(df: Column | str, n: Column | int) -> Column:
    """0.1 + ln((N + 1) / (1 + df))"""
    n = F.lit(n) if isinstance(n, int) else n
    return F.lit(0.1) + F.log((n + 1) / (1 + col(df)))


def round2(c: Column | str) -> Column:
    """Half up on the double itself, at two decimals."""
    return F.floor(col(c) * 100 + 0.5) / 100


def last_segment(c: Column | str) -> Column:
    out = F.trim(col(c))
    for mark in ("/", "::", "."):
        out = F.substring_index(out, mark, -1)
    return F.trim(out)


def slug(c: Column | str, empty: str = "node") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", F.lit(empty)).otherwise(out)


def safe_key(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9._-]", "-"), "^[-.]+|[-.]+$", "")


def safe_path(c: Column | str) -> Column:
    return F.array_join(F.filter(F.transform(F.split(col(c), "/"), safe_key), lambda p: p != ""), "/")


def npm_package(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "^(@[^/]+/[^/]+|[^/]+)", 1)


def route_path(*parts: Column) -> Column:
    """Parts joined with one slash between them and one in front."""
    trimmed = [F.regexp_replace(p, "^/+|/+$", "") for p in parts]
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(*trimmed), lambda p: p != ""), "/"))


def parent_dir(c: Column | str) -> Column:
    """Directory of a path; empty for URIs and files at the root."""
    return F.when(F.contains(col(c), F.lit("://")), F.lit("")).otherwise(F.regexp_extract(col(c), "^(.*)/[^/]+$", 1))


def prefixes(c: Column | str, mark: str) -> Column:
    """Every leading part of a string cut at ``mark``, the whole included, shortest first."""
    parts = F.split(col(c), "[" + mark + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), mark))


def location_lines(c: Column | str) -> tuple[Column, Column]:
    """First and last line of ``L12`` or ``L12-L20`` / ``L12-20``; null without one."""
    first = F.nullif(F.regexp_extract(col(c), r"L(\d+)(?:-L?(\d+))?", 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(col(c), r"L(\d+)(?:-L?(\d+))?", 2), F.lit("")).cast("int")
    return first, F.coalesce(last, first)


def body_slice(text: Column | str, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of a text."""
    lines = F.split(col(text), "\n")
    size = F.least(last, F.size(lines)) - first + 1
    return F.when((first < 1) | (size < 1), F.lit("")).otherwise(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(size, F.lit(0))), "\n"))


def body_head(text: Column | str, max_lines: int, max_bytes: int) -> Column:
    """The first lines of a text, cut to a number of bytes; a last line says how many lines were left out."""
    lines = F.split(col(text), "\n")
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    raw = F.substring(F.encode(head, "UTF-8"), 1, max_bytes).cast("string")
    cut = F.when(F.octet_length(head) > max_bytes, F.make_valid_utf8(raw)).otherwise(head)
    left = F.size(lines) - max_lines
    return F.when(left > 0, F.concat(cut, F.lit("\n… "), left.cast("string"), F.lit(" more"))).otherwise(cut)


def is_test_path(c: Column | str) -> Column:
    """Test sources (search): a test folder, or a file name by one of the usual conventions."""
    path = col(c)
    lower = F.lower(path)
    name = F.substring_index(lower, "/", -1)
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    named = name.rlike(r"^test_|\.spec\.|\.test\.|_test(\.[^.]*)?$")
    return lower.rlike("(^|/)tests?/") | named | (name.rlike(r"\.(java|cs)$") & stem.rlike("Tests?$"))


# Fixed value: the pattern that change plans take for test sources.
PLAN_TEST = r"(_test\.(go|py|rb)$|\.(test|spec)\.[jt]sx?$|(^|/)tests?/|\.Tests(/|$)|(^|/)test_)"


def is_plan_test(c: Column | str) -> Column:
    return col(c).rlike(PLAN_TEST)


def is_stub(c: Column | str) -> Column:
    return F.startswith(col(c), F.lit("module://"))


def is_secret_name(c: Column | str) -> Column:
    name = F.lower(F.substring_index(col(c), "/", -1))
    return name.rlike("secret|credential|password") | F.startswith(name, F.lit(".env"))


# Raw dependency scopes by class.
SCOPES = {
    "runtime": ("dependencies", "require", "compile", "implementation", "api", "runtimeOnly", "package", "runtime"),
    "dev": ("devDependencies", "developmentOnly"),
    "peer": ("peerDependencies",),
    "indirect": ("indirect",),
    "build": ("provided", "system", "import", "parent", "plugin", "compileOnly", "annotationProcessor", "kapt"),
    "test": ("test",),
    "optional": ("optional",),
}


def scope_class(c: Column | str) -> Column:
    """Class of a raw dependency scope; test for every other scope that begins so; null if unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for label, raws in SCOPES.items():
        out = out.when(col(c).isin(*raws), F.lit(label))
    return out.when(F.startswith(F.lower(col(c)), F.lit("test")), F.lit("test"))


def sanitized_url(c: Column | str) -> Column:
    """A URL without user info and credential parameters; http URLs lose the whole query."""
    out = F.regexp_replace(col(c), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    web = F.lower(out).rlike("^https?://")
    quiet = F.regexp_replace(out, r"(?i)([?&])(password|passwd|pwd|token|secret|api_?key|access_?key|user)=[^&#]*&?", "$1")
    return F.when(web, F.regexp_replace(out, r"[?#].*$", "")).otherwise(F.regexp_replace(quiet, r"[?&]$", ""))


def xml_escaped(c: Column | str) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def quoted(c: Column | str) -> Column:
    """A double-quoted string with backslash escapes."""
    out = F.replace(F.replace(col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def table_cell(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def decay(age_days: Column | str, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(col(age_days), F.lit(0.0)) / half_life)


def clipped(c: Column | str, size: int = 120) -> Column:
    return F.substr(col(c), F.lit(1), F.lit(size))


def short_sha(c: Column | str) -> Column:
    """The first seven characters, a question mark for none."""
    return F.when(F.coalesce(col(c), F.lit("")) == "", F.lit("?")).otherwise(F.substr(col(c), F.lit(1), F.lit(7)))


def age_text(seconds: Column | str) -> Column:
    """Seconds, minutes, hours (below two days) or days, whole."""
    s = col(seconds).cast("long")
    steps = F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m")))
    return steps.when(s < 48 * 3600, F.concat(F.floor(s / 3600), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d")))


def default_module_name(path: Column | str) -> Column:
    return F.replace(F.regexp_replace(col(path), "^/+|/+$", ""), F.lit("/"), F.lit("-"))
