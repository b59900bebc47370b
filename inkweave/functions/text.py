"""Text expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkweave.config import SEARCH_STOPWORDS, STOPWORDS

#: The characters of Unicode's White_Space property, as the inside of a character class.
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def trim_all(c: Column) -> Column:
    """Without outer white space in the sense of Unicode."""
    return F.regexp_replace(c, rf"^[{SPACES}]+|[{SPACES}]+$", "")


def is_external(c: Column) -> Column:
    """A link that leaves the corpus: a scheme of the web, mail, phone or file transfer, or ``//``."""
    return trim_all(c).rlike(r"^(?i)(?:(?:https?|mailto|tel|ftp):|//)")


def file_key(c: Column) -> Column:
    """What link targets and file names are compared by: the last path segment, lower-case, without query and fragment."""
    bare = F.regexp_replace(trim_all(c), r"(?s)[#?].*$", "")
    bare = F.regexp_replace(bare, r"^(?:\./)+|/+$", "")
    return F.lower(F.regexp_replace(bare, r"(?s)^.*[/\\]", ""))


def tokens(c: Column) -> Column:
    """Lower-case words of 3 to 30 letters and digits, without pure numbers and stop words; null for null."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 30) & ~w.rlike(r"^\d+$") & ~w.isin(*STOPWORDS))


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, f"[{SPACES}]+"), lambda w: w != "")


def collapse(c: Column) -> Column:
    """White space collapsed to single spaces, none outside."""
    return trim_all(F.regexp_replace(c, f"[{SPACES}]+", " "))


def summary(c: Column, most: int = 200) -> Column:
    """The collapsed text, cut to ``most`` characters with an ellipsis."""
    flat = collapse(c)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r" +$", ""), F.lit("…")))


def clip(c: Column, most: int) -> Column:
    """The trimmed text, cut at the last space beyond 60 % of the limit, else at the limit, with an ellipsis."""
    c = trim_all(c)
    head = F.substring(c, 1, most)
    stem = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(stem) > most * 0.6, stem).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit("…")))


def base_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"(?s)^.*/", "")


def parent_dir(c: Column) -> Column:
    """The folder of a path; null where there is none, or only the root."""
    p = F.regexp_replace(c, r"\\", "/")
    stem = F.regexp_extract(p, r"(?s)^(.+)/[^/]*$", 1)
    return F.when(stem != "", stem)


def strip_ext(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.[a-z0-9]{1,8}$", "")


def title_case(c: Column) -> Column:
    """The first character of each word upper-case, the rest as it is."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def title_of_file(c: Column) -> Column:
    """A title from a file name: no folder, no extension, dashes and underscores as spaces, words capitalised."""
    base = base_name(c)
    named = trim_all(F.regexp_replace(strip_ext(base), r"[-_]+", " "))
    return F.when(named == "", base).otherwise(title_case(F.regexp_replace(named, r"\s+", " ")))


#: File types by extension.
FILE_TYPES = {"txt": "txt", "log": "txt", "md": "md", "mdx": "md", "htm": "html", "html": "html", "pdf": "pdf", "json": "json", "yaml": "yaml", "yml": "yaml", "csv": "csv", "docx": "docx", "docm": "docx", "pptx": "pptx", "pptm": "pptx", "xlsx": "xlsx", "xlsm": "xlsx"}


def file_type(c: Column) -> Column:
    """The file type by the extension; null without a known one (a name that begins or ends with its only dot has none)."""
    ext = F.lower(F.regexp_extract(c, r"(?s)^.+\.([^.]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv]), ext)


#: Media types by extension.
MEDIA_TYPES = {
    "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "mdx": "text/markdown", "pdf": "application/pdf", "html": "text/html", "htm": "text/html", "json": "application/json", "yaml": "application/yaml", "yml": "application/yaml", "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptm": "application/vnd.ms-powerpoint.presentation.macroEnabled.12",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12",
}


def media_type(c: Column) -> Column:
    """The media type by a file name's extension, ``application/octet-stream`` without a known one."""
    ext = F.lower(F.regexp_extract(c, r"(?s)^.+\.([^.]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext)
    return F.when(c.isNotNull(), F.coalesce(known, F.lit("application/octet-stream")))


def cluster_hue(c: Column) -> Column:
    """A cluster's hue in degrees: from 210 on in steps of the golden angle; null below 0."""
    return F.when(c >= 0, F.pmod(F.lit(210.0) + c * F.lit(137.508), F.lit(360.0)))


def canonical_topic(c: Column) -> Column:
    """Lower-case, white space, slashes, underscores, commas and dashes as single spaces."""
    return trim_all(F.regexp_replace(F.lower(c), rf"[{SPACES}/\\_,-]+", " "))


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters of at most ``most`` UTF-8 bytes."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, most)
    # bytes of a character that was cut apart: up to three continuation bytes after their lead
    tail = F.regexp_replace(F.hex(cut), r"(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    aligned = F.decode(F.unhex(F.when(F.length(tail) % 2 == 0, tail).otherwise(F.hex(cut))), "UTF-8")
    return F.when(F.octet_length(c) <= most, c).otherwise(aligned)


def retrieval_terms(c: Column) -> Column:
    """Distinct search terms in the order they appear."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9+#._-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*SEARCH_STOPWORDS)))


def normal(c: Column) -> Column:
    return collapse(F.lower(c))


def search_terms(query: str) -> list[str]:
    """``retrieval_terms`` of a query that is known when the plan is made."""
    found = (t for t in re.findall(r"[a-z0-9][a-z0-9+#._-]*", query.lower()) if len(t) > 1 and t not in SEARCH_STOPWORDS)
    return list(dict.fromkeys(found))


def lexical_relevance(query: str, body: Column, head: Column) -> Column:
    """STRUCT<score DOUBLE, title_match BOOLEAN> of a passage for a query: coverage of its terms, with bonuses for the title and the exact phrase.

    ``body`` and ``head`` are passage and title in the form of ``normal``, held in columns: they are read once for each term.
    """
    terms, q = search_terms(query), " ".join(query.lower().split())
    if not terms:
        return F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("title_match"))
    share = lambda where: sum((F.contains(where, F.lit(t)).cast("int") for t in terms), F.lit(0)) / len(terms)
    in_title = (head != "") & F.contains(head, F.lit(q))
    phrase = F.contains(body, F.lit(q)) if len(q) > 2 else F.lit(False)
    ok = in_title | phrase | (share(body) >= (1.0 if len(terms) == 1 else 0.4))
    score = share(body) + share(head) * 0.35 + F.when(phrase, 0.2).otherwise(0.0) + F.when(in_title, 0.35).otherwise(0.0)
    return F.struct(F.when(ok, score).otherwise(0.0).alias("score"), (ok & in_title).alias("title_match"))


def keyword_evidence(text: Column, terms: Column, most: int) -> Column:
    """A window of ``most`` characters around the first term found, three tenths of it before; the beginning where none is."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda i: i > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - F.floor(F.lit(0.3 * most)).cast("int"), F.lit(1))
    return trim_all(F.substring(text, start, F.lit(most)))


def time_ago(then_ms: Column, now_ms: Column) -> Column:
    """How long ago, in the largest whole unit."""
    hours = (now_ms - then_ms) / 3_600_000
    out = F.when(hours < 1, F.lit("just now"))
    for unit, size, above in (("hour", 1, 24), ("day", 24, 168), ("week", 168, 720), ("month", 720, 8760), ("year", 8760, None)):
        n = F.floor(hours / size).cast("string")
        label = F.concat(n, F.lit(f" {unit}"), F.when(n == "1", F.lit(" ago")).otherwise(F.lit("s ago")))
        out = out.when(hours < above, label) if above else out.otherwise(label)
    return F.when(then_ms.isNotNull(), out)


def parse_model_json(c: Column, schema: str) -> Column:
    """A model's JSON answer, with or without code fences; null where it is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    # as the only element of an array: text after the value makes that no JSON
    one = lambda x: F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    sound = F.when(one(c), c).when((fenced != "") & one(fenced), fenced)
    return F.when(sound.rlike(r"^\s*[\[{]"), F.from_json(sound, schema))


def graph_id(path: Column, content: Column) -> Column:
    """The identity of a file: a hash of its path and bytes."""
    return F.sha2(F.concat(F.encode(path, "UTF-8"), F.unhex(F.lit("00")), content), 256)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two vectors, accumulated in double precision; null where the sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot)
