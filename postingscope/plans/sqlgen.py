"""SQL text for the DuckDB oracle of each registered query.

The oracle is written independently in plain SQL over the benchmark tables;
these helpers only render lexicons and shared derived views as SQL text.
Regular expressions use RE2 syntax with the same explicit classes as the
Spark side.
"""

from __future__ import annotations

from postingscope import lexicons as L
from postingscope.functions.text import WS, WS_CHARS
from postingscope.sources import driver as D


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def blank(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, '[^{WS_CHARS}]'))"


def words(e: str) -> str:
    return f"len(regexp_extract_all(lower(coalesce({e}, '')), '[\\p{{L}}\\p{{N}}_]+'))"


def hits(e: str, phrases) -> str:
    ps = [p.strip().lower() for p in phrases if p and p.strip()]
    if not ps:
        return "0"
    lt = f"lower(coalesce({e}, ''))"
    return "(" + " + ".join(f"(CASE WHEN contains({lt}, {q(p)}) THEN 1 ELSE 0 END)" for p in ps) + ")"


def rnd(e: str, n: int) -> str:
    """Python's round(x, n) on the exact binary value: the error of the
    scaled product (Dekker split) decides values landing on .5."""
    s = dbl(10 ** n)
    case = (f"CASE WHEN abs(p) >= 4503599627370496.0 THEN x "
            f"WHEN p - fl > 0.5 THEN (fl + 1.0) / {s} WHEN p - fl < 0.5 THEN fl / {s} "
            f"WHEN ((hi * {s} - p) + (x - hi) * {s}) > 0 THEN (fl + 1.0) / {s} "
            f"WHEN ((hi * {s} - p) + (x - hi) * {s}) < 0 THEN fl / {s} "
            f"WHEN fl % 2 = 0 THEN fl / {s} ELSE (fl + 1.0) / {s} END")
    return (f"list_transform([CAST({e} AS DOUBLE)], lambda x: "
            f"list_transform([x * {s}], lambda p: "
            f"list_transform([CAST(floor(p) AS DOUBLE)], lambda fl: "
            f"list_transform([(134217729.0 * x) - ((134217729.0 * x) - x)], lambda hi: "
            f"{case})[1])[1])[1])[1]")


def clamp01r4(e: str) -> str:
    return f"least(1.0, greatest(0.0, {rnd(e, 4)}))"


def density(e: str, phrases, scale: float) -> str:
    w = words(e)
    return (f"(CASE WHEN {w} = 0 THEN 0.0 ELSE "
            f"{clamp01r4(f'{hits(e, phrases)} / greatest(15, {w}) * {dbl(scale)}')} END)")


def genericness(e: str, phrases=None) -> str:
    return density(e, L.GENERIC_BUZZWORDS if phrases is None else phrases, L.GENERICNESS_SCALE)


def urgency(e: str, phrases=None) -> str:
    return density(e, L.URGENCY_PHRASES if phrases is None else phrases, L.URGENCY_SCALE)


def repost(e: str) -> str:
    return f"(CASE WHEN {e} IS NULL OR {e} = 0 THEN 0.0 ELSE {clamp01r4('least(1.0, 0.4 + 1 * 0.15)')} END)"


def rule_prob(g: str, v: str, r: str, u: str, text: str) -> str:
    a, b, c, d = L.RULE_WEIGHTS
    return (f"(CASE WHEN {blank(text)} THEN 0.0 ELSE "
            f"{clamp01r4(f'{dbl(a)} * {g} + {dbl(b)} * {v} + {dbl(c)} * {r} + {dbl(d)} * {u}')} END)")


def frustration(e: str, weighted=None, baseline: str = "0.0") -> str:
    wp = [(p.strip().lower(), float(w)) for p, w in
          (L.FRUSTRATION_PHRASES if weighted is None else weighted) if p and p.strip()]
    lt = f"lower(coalesce({e}, ''))"
    m = "(" + " + ".join(f"(CASE WHEN contains({lt}, {q(p)}) THEN 1 ELSE 0 END)" for p, _ in wp) + ")"
    s = "(" + " + ".join(f"(CASE WHEN contains({lt}, {q(p)}) THEN {dbl(w)} ELSE {dbl(0.0)} END)"
                         for p, w in wp) + ")"
    s = f"({dbl(0.0)} + " + s[1:]
    cap, scale = L.FRUSTRATION_DENSITY
    dens = f"(CASE WHEN {m} = 0 THEN 0.0 ELSE least(1.0, {s} / least({dbl(cap)}, CAST({m} AS DOUBLE)) * {dbl(scale)}) END)"
    a, b = L.FRUSTRATION_BLEND
    return f"(CASE WHEN {blank(e)} THEN 0.0 ELSE {clamp01r4(f'{dbl(a)} * {baseline} + {dbl(b)} * {dens}')} END)"


def elapsed_days(ts: str, as_of: str) -> str:
    return (f"(CASE WHEN {ts} IS NULL THEN NULL ELSE "
            f"greatest(0, CAST(floor((epoch_us({as_of}) - epoch_us({ts})) / 86400000000.0) AS BIGINT)) END)")


def final_score(g, v, r, u, b, s, weights=None) -> str:
    w = L.DEFAULT_WEIGHTS if weights is None else weights
    wsum = sum(w.values())
    if wsum == 0:
        return "0.0"
    keys = ["genericness", "vagueness", "repost", "urgency", "bert_classifier", "company_sentiment"]
    terms = [f"{dbl(w.get(k, L.DEFAULT_WEIGHTS[k]))} * {c}" for k, c in zip(keys, [g, v, r, u, b, s])]
    raw = terms[0]
    for t in terms[1:]:
        raw = f"({raw} + {t})"
    return f"least(100.0, greatest(0.0, {rnd(f'{raw} / {dbl(wsum)} * 100.0', 2)}))"


AS_OF = f"TIMESTAMP '{D.AS_OF}'"

# Shared derived views (mirror sources/driver.py, written as SQL).
POSTINGS = f"""
postings AS (
  SELECT doc_id AS id, source AS company,
         {strip("split_part(text, chr(10), 1)")} AS title,
         text AS description,
         'https://jobs.example.com/' || source || '/' ||
           sha256(text) AS url,
         CASE WHEN lang = 'en' THEN 'career' WHEN lang = 'fr' THEN 'cards_a' ELSE 'cards_b' END AS source,
         TIMESTAMP '{D.EPOCH}' + doc_id * INTERVAL 1 MINUTE - (n_chars % 30) * INTERVAL 1 DAY AS posted_date,
         TIMESTAMP '{D.EPOCH}' + doc_id * INTERVAL 1 MINUTE AS scraped_at,
         nullif(regexp_extract(text, '[$€£] ?[0-9][0-9,.]*', 0), '') AS salary_listed,
         lang AS location,
         CAST(NULL AS VARCHAR) AS cleaned_text,
         CAST(NULL AS BIGINT) AS repost_of_id
  FROM documents
)"""

REVIEWS = f"""
reviews AS (
  SELECT conv_id * {D.TURNS} + turn AS id, 'src' || CAST(conv_id % {D.N_COMPANIES} AS VARCHAR) AS company,
         'forum' AS source, text,
         TIMESTAMP '2024-01-30 00:00:00' - (conv_id % 120) * INTERVAL 1 DAY AS posted_at,
         TIMESTAMP '2024-01-31 00:00:00' AS scraped_at
  FROM conversations WHERE role = 'user'
)"""

INCOMING = """
incoming AS (
  SELECT p.id, coalesce('c' || CAST(e.label AS VARCHAR), p.company) AS company, p.title, p.description, p.url,
         p.source, p.posted_date, p.scraped_at, p.salary_listed, p.location, e.embedding
  FROM postings p LEFT JOIN embeddings e ON e.vec_id = p.id
)"""

PAGE_EVENTS = f"""
page_events AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value AS engagement,
         '/company/src' || CAST(user_id % {D.N_COMPANIES} AS VARCHAR) || '.html' AS page_path
  FROM events
)"""

COMPANIES = """
companies AS (
  SELECT d.name,
         CASE WHEN CAST(regexp_extract(d.name, '([0-9]+)$', 1) AS INTEGER) % 7 = 6 THEN NULL
              ELSE lower(r.r_name) END AS industry,
         'https://careers.example.com/' || d.name AS career_url,
         'software engineer' AS query, 'Remote' AS location
  FROM (SELECT DISTINCT source AS name FROM documents) d
  LEFT JOIN region r ON CAST(regexp_extract(d.name, '([0-9]+)$', 1) AS INTEGER) % 5 = r.r_regionkey
)"""


def review_scores_sql(weighted=None, lam: float = L.DECAY_LAMBDA) -> str:
    """Per-review frustration and weight (baseline 0: no valence table)."""
    return f"""
review_scores AS (
  SELECT *, {frustration('text', weighted, '0.0')} AS frustration,
         exp({dbl(-lam)} * {elapsed_days('coalesce(posted_at, scraped_at, ' + AS_OF + ')', AS_OF)}) AS weight
  FROM reviews
)"""


def sentiment_sql(weighted=None, lam: float = L.DECAY_LAMBDA) -> str:
    return f"""
sentiment AS (
  SELECT company,
         coalesce({clamp01r4('sum(weight * frustration) / nullif(sum(weight), 0)')}, 0.0) AS score,
         CAST(count(*) AS INTEGER) AS review_count
  FROM review_scores GROUP BY company
)"""


NOUNS = """
nouns AS (
  SELECT token, CASE WHEN length(token) > 3 THEN regexp_replace(token, 's$', '') ELSE token END AS lemma,
         length(token) % 7 = 0 AS is_proper
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM benchmark)
  WHERE length(token) >= 3
)"""


def vague_sql(vague, src: str = "postings") -> str:
    """vg(id, vagueness_score): FEAT3 with the noun table, for postings that hold a noun."""
    return NOUNS + f""",
toks AS (SELECT id, regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {src}),
toks1 AS (SELECT id, unnest(t) AS token, unnest(list_concat([NULL], t[:len(t) - 1])) AS prev FROM toks),
nouncount AS (SELECT e.id, count(*) AS n,
               count(*) FILTER (WHERE n.lemma IN ({", ".join(q(v) for v in vague)}) AND NOT n.is_proper
                                AND NOT coalesce(regexp_full_match(prev, '[0-9]+'), false)) AS v
        FROM toks1 e JOIN nouns n USING (token) GROUP BY e.id),
vg AS (SELECT id, {clamp01r4('v / n')} AS vagueness_score FROM nouncount)"""


def features_sql(src: str = "postings", generic=None, urgent=None, vague: bool = False) -> str:
    """`vague`: the CTE vg (vague_sql) is there; else no token counts as a noun."""
    v, join = ("coalesce(vg.vagueness_score, 0.0)", " LEFT JOIN vg USING (id)") if vague else ("CAST(0.0 AS DOUBLE)", "")
    text = "coalesce(nullif(cleaned_text, ''), nullif(description, ''), '')"
    g = genericness("_text", generic)
    return f"""
feat0 AS (SELECT *, {text} AS _text FROM {src}),
feat1 AS (
  SELECT feat0.*, {g} AS genericness_score, {v} AS vagueness_score, {urgency('_text', urgent)} AS urgency_score,
         {repost('repost_of_id')} AS repost_score
  FROM feat0{join}
),
features AS (
  SELECT *, {rule_prob('genericness_score', 'vagueness_score', 'repost_score', 'urgency_score', '_text')} AS bert_score
  FROM feat1
)"""


def scores_sql(weights=None) -> str:
    fs = final_score("f.genericness_score", "f.vagueness_score", "f.repost_score", "f.urgency_score",
                     "f.bert_score", "coalesce(s.score, 0.0)", weights)
    return f"""
scores AS (
  SELECT f.id AS job_posting_id, f.company, f.genericness_score, f.vagueness_score, f.repost_score,
         f.urgency_score, f.bert_score, coalesce(s.score, 0.0) AS sentiment_score,
         {fs} AS final_score
  FROM features f LEFT JOIN sentiment s ON f.company = s.company
)"""


# ----------------------------------------------------------------- text
def strip_markup(e: str) -> str:
    out = e
    for tag in L.DROPPED_ELEMENTS:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    return f"(CASE WHEN contains({e}, '<') AND contains({e}, '>') THEN {out} ELSE {e} END)"


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def unescape(e: str) -> str:
    out = e
    for ent, ch in ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def boilerplate(e: str) -> str:
    out = e
    for p in L.BOILERPLATE_PATTERNS:
        out = f"regexp_replace({out}, {q(p)}, ' ', 'g')"
    return out


def squash(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, '[\\r\\t\\f\\x{{0B}}]+', ' ', 'g'), '[ \\t]+', ' ', 'g')"


def gap(e: str) -> str:
    return f"""regexp_replace({e}, '([a-z0-9.)''"])([.!?])([A-Z])', '\\1\\2 \\3', 'g')"""


def trim_lines(e: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), "
            f"lambda x: {strip('x')}), lambda x: x <> ''), chr(10))")


def clean(e: str) -> str:
    body = trim_lines(gap(squash(boilerplate(unescape(strip_markup(e))))))
    return f"(CASE WHEN {e} IS NULL OR {e} = '' THEN '' ELSE {body} END)"


def slugify(e: str) -> str:
    s1 = strip(f"lower({e})")
    s2 = f"regexp_replace({s1}, '[^\\p{{L}}\\p{{N}}_{WS_CHARS}-]', '', 'g')"
    return f"regexp_replace({s2}, '[{WS_CHARS}-]+', '-', 'g')"


def title_case(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({e}, ''), lambda ch, i: "
            f"CASE WHEN i = 1 OR NOT regexp_full_match(string_split({e}, '')[i - 1], '\\p{{L}}') "
            f"THEN upper(ch) ELSE lower(ch) END), '')")


PAGE_POSTINGS = """
page_postings AS (
  SELECT page_id AS id,
         upper(substr(split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '.', 1), 1, 1))
           || lower(substr(split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), '.', 1), 2))
           AS company,
         regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) AS title,
         html AS description,
         split_part(url, '?', 1) AS url,
         'career' AS source,
         CASE WHEN contains(url, '#') THEN regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) END AS cleaned_text
  FROM pages
)"""
