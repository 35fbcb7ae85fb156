"""Text, metadata and time projections (Column -> Column).

All of these are built-in Spark expressions (whole-stage codegen) except
`unescape`/`nfkc`, which have no JVM builtin and run as one Arrow-batched
pandas UDF.  Regular expressions avoid back-references and use explicit
character classes so that Java regex and RE2 (the SQL oracle) agree.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postingscope import lexicons as L

# Characters Python's str.strip()/isspace() treat as whitespace.  Java's
# and RE2's `\s` are ASCII-only and differ on \x0B, so spell it out.
WS_CHARS = (r"\t\n\r\f\x{0B} \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
# Python's unicode `\w`: letters, numbers, underscore.
WORD = r"[\p{L}\p{N}_]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python `str.strip()`: drop leading/trailing (unicode) whitespace."""
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def is_blank(c) -> Column:
    """True for null, empty or whitespace-only text."""
    c = col(c)
    return c.isNull() | ~c.rlike(NON_WS)


def word_count(c) -> Column:
    """Number of unicode word tokens in lower(c) (0 for null)."""
    return F.coalesce(F.regexp_count(F.lower(col(c)), F.lit(WORD)), F.lit(0))


# --------------------------------------------------------------------- TXT1
def _drop_spans(c: Column, start: str, end: str, mark: str | None = None) -> Column:
    """Every span from `start` to the next `end` becomes a space.

    Only the text up to the last `end` is searched: openings after it are
    never closed, and each would scan to the end of the text in vain.  The
    one-element array names the text once, however often it is used.  A text
    without the lower-case `mark`, part of every `end`, is left as it is.
    """
    def closed_part(x):
        head = F.regexp_extract(x, f"(?is)^.*{end}", 0)
        return F.concat(F.regexp_replace(head, f"(?is){start}.*?{end}", " "),
                        x.substr(F.length(head) + 1, F.length(x)))

    def guarded(x):
        return closed_part(x) if mark is None else F.when(F.contains(F.lower(x), F.lit(mark)), closed_part(x)).otherwise(x)
    return F.element_at(F.transform(F.array(c), guarded), 1)


def _drop_literal(c: Column, span: str, end: str) -> Column:
    """Every span becomes a space; the text after the last `end`, where no span can close, is not searched."""
    def closed_part(x):
        tail = F.length(F.substring_index(x, end, -1))
        return F.concat(F.regexp_replace(x.substr(F.lit(1), F.length(x) - tail), span, " "), x.substr(F.length(x) - tail + 1, F.length(x)))
    return F.element_at(F.transform(F.array(c), closed_part), 1)


def strip_markup(c, elements=None) -> Column:
    """Drop whole non-content elements, comments, then remaining tags.

    Applied only when the text contains both '<' and '>'.  Each element is
    removed with its own pattern (no back-references), one pass per tag that
    the text closes somewhere.
    """
    c = col(c)
    out = c
    for tag in (elements or L.DROPPED_ELEMENTS):
        out = _drop_spans(out, rf"<{tag}\b[^>]*>", rf"</{tag}\s*>", f"</{tag}".lower())
    out = _drop_literal(out, "(?s)<!--.*?-->", "-->")
    out = _drop_literal(out, "(?s)<[^>]*>", ">")
    return F.when(c.contains("<") & c.contains(">"), out).otherwise(c)


# ------------------------------------------------------------- TXT2 / TXT3
def _unescape_series(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if isinstance(t, str) else t)


def _nfkc_series(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)


def _unescape_nfkc_series(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t))
                 if isinstance(t, str) else t)


_unescape_udf = F.pandas_udf(_unescape_series, T.StringType())
_nfkc_udf = F.pandas_udf(_nfkc_series, T.StringType())
_unescape_nfkc_udf = F.pandas_udf(_unescape_nfkc_series, T.StringType())


NON_ASCII = r"[^\x00-\x7F]"


def _only_where(needed: Column, udf, c: Column) -> Column:
    """The function's result where it can change the text; other texts are not sent to Python (a null is)."""
    return F.when(needed, udf(F.when(needed, c))).otherwise(c)


def unescape(c) -> Column:
    """HTML entity decoding (named and numeric), one pass."""
    return _only_where(col(c).contains("&"), _unescape_udf, col(c))


def nfkc(c) -> Column:
    """Unicode NFKC normalisation (U+00A0 becomes a space; U+200B is kept)."""
    return _only_where(col(c).rlike(NON_ASCII), _nfkc_udf, col(c))


def unescape_nfkc(c) -> Column:
    """TXT2 then TXT3 fused into one Arrow round trip."""
    return _only_where(col(c).contains("&") | col(c).rlike(NON_ASCII), _unescape_nfkc_udf, col(c))


# XML entities plus the ones found in captured pages, decoded without Python
# (`&amp;` last so that double-escaped text is decoded exactly once).
BASIC_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                  ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
                  ("&middot;", "·"), ("&amp;", "&")]


def unescape_basic(c) -> Column:
    """JVM-only entity decoding for the common named entities."""
    out = col(c)
    for ent, ch in BASIC_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


# --------------------------------------------------------------- TXT4 - 7
def strip_boilerplate(c, patterns=None) -> Column:
    out = col(c)
    for p in (patterns or L.BOILERPLATE_PATTERNS):
        out = F.regexp_replace(out, p, " ")
    return out


# The patterns of whitespace runs, sentence gaps and slugs below are fixed values of the cleaner's contract.
def squash_ws(c) -> Column:
    out = F.regexp_replace(col(c), r"[\r\t\f\x{0B}]+", " ")
    return F.regexp_replace(out, r"[ \t]+", " ")


def fix_sentence_gap(c) -> Column:
    return F.regexp_replace(col(c), r"""([a-z0-9.)'"])([.!?])([A-Z])""", "$1$2 $3")


# Whitespace except the line feed, for per-line trimming.
WS_NO_LF = WS_CHARS.replace(r"\n", "")


def trim_lines(c) -> Column:
    """Strip every line, drop empty lines, rejoin with '\n' -- as three
    regex passes (codegen'd, no per-line arrays).  `(?md)`: only '\n' ends a
    line, as for Python's split('\n')."""
    out = F.regexp_replace(col(c), f"(?md)^[{WS_NO_LF}]+|[{WS_NO_LF}]+$", "")
    out = F.regexp_replace(out, "\n+", "\n")
    return F.regexp_replace(out, "^\n|\n$", "")


# --------------------------------------------------------------------- TXT8
def clean_text(c, *, entity_decoder=unescape_nfkc, patterns=None) -> Column:
    """Full cleaner: markup, entities, NFKC, boilerplate, whitespace,
    sentence gaps, line trim.  Null or blank input gives ''."""
    c = col(c)
    out = strip_markup(c)
    out = entity_decoder(out)
    out = strip_boilerplate(out, patterns)
    out = squash_ws(out)
    out = fix_sentence_gap(out)
    out = trim_lines(out)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(out)


# --------------------------------------------------------------------- TXT9
def best_text(cleaned="cleaned_text", description="description") -> Column:
    """Cleaned text, else description, else ''; empty strings fall through."""
    return F.coalesce(F.nullif(col(cleaned), F.lit("")), F.nullif(col(description), F.lit("")),
                      F.lit(""))


# -------------------------------------------------------------------- TXT10
def slugify(c) -> Column:
    out = strip_ws(F.lower(col(c)))
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}_{WS_CHARS}-]", "")
    return F.regexp_replace(out, rf"[{WS_CHARS}-]+", "-")


# -------------------------------------------------------------------- META1
def has_salary(c) -> Column:
    v = F.lower(strip_ws(col(c)))
    return F.coalesce(~v.isin("none", "null", ""), F.lit(False))


# -------------------------------------------------------------------- META2
def elapsed_days(ts, as_of) -> Column:
    """max(0, floor(elapsed seconds / 86400)) -- elapsed, not calendar, days."""
    micros = F.unix_micros(col(as_of)) - F.unix_micros(col(ts))
    days = F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000)).cast("long"))
    return F.when(col(ts).isNull(), F.lit(None).cast("long")).otherwise(days)


def days_since(posted="posted_date", scraped="scraped_at", as_of=None) -> Column:
    """Days since posted_date, else scraped_at, else null."""
    return elapsed_days(F.coalesce(col(posted), col(scraped)), as_of)


# -------------------------------------------------------------------- TIME1
def parse_relative_time(c, as_of) -> Column:
    """'2024-01-05…', 'just posted', '3 days ago', '2 weeks ago', '1 month ago'.

    Precedence: ISO prefix, now-words, days, weeks, months; anything else
    (including unparsable ISO dates) is `as_of`.
    """
    as_of = col(as_of)
    s = F.lower(strip_ws(col(c)))

    def minus_days(n_days):
        return F.timestamp_micros(F.unix_micros(as_of) - n_days * F.lit(86_400_000_000))

    # fixed values: the date prefix, the words for "now" and (in lexicons) the units
    branch = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
                    F.coalesce(F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")), as_of))
    branch = branch.when(s.contains("just") | s.contains("today") | s.contains("hour")
                         | s.contains("minute"), as_of)
    for unit, days in L.RELATIVE_UNITS:
        n = F.regexp_extract(s, rf"([0-9]+){WS}+{unit}", 1).try_cast("bigint")
        branch = branch.when(s.rlike(rf"[0-9]+{WS}+{unit}"),
                             F.when(n <= 700_000 // days, minus_days(n * days)).otherwise(as_of))
    return F.when(col(c).isNull(), as_of).otherwise(branch.otherwise(as_of))


# -------------------------------------------------------------------- HASH1
HASHED = 250        # characters of a description that the content hash reads


def content_hash(company="company", title="title", description="description") -> Column:
    key = F.concat_ws(":", F.lower(strip_ws(col(company))), F.lower(strip_ws(col(title))),
                      strip_ws(F.substring(F.coalesce(col(description), F.lit("")), 1, HASHED)))
    return F.sha2(key, 256)


# --------------------------------------------------------------------- URL1
def canonical_url(c) -> Column:
    return F.split(col(c), r"\?").getItem(0)


def company_from_url(c) -> Column:
    host = F.try_parse_url(col(c), F.lit("HOST"))
    first = F.split(host, r"\.").getItem(0)
    return F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1 << 20)))


# -------------------------------------------------------------------- META3
def extract_metadata(df, as_of):
    return df.select(
        F.col("id"),
        F.coalesce(F.col("company"), F.lit("Unknown")).alias("company"),
        F.coalesce(F.col("title"), F.lit("Untitled")).alias("title"),
        has_salary("salary_listed").alias("salary_listed"),
        F.col("posted_date").alias("posting_date"),
        days_since("posted_date", "scraped_at", as_of).alias("days_since_posted"),
    )


# -------------------------------------------------------------------- RPT5
def fmt_duration(c) -> Column:
    secs = col(c)
    return F.format_string("%dm %02ds", F.floor(secs / 60).cast("int"),
                           F.floor(F.pmod(secs, F.lit(60.0))).cast("int"))
