"""Registered queries of the engine and the DuckDB SQL that each must equal.

Every query runs over its whole table.  Arrays of strings are joined, so that both engines show them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import PII, Config, Injection, Policy, Rerank
from ..functions import html as H, text as T, urls as U
from ..functions.once import evaluated, let
from ..operators import extract, format as fmt, injection, pii, policy, provenance, rank, scrape, search, spans, telemetry
from ..streaming import alerts
from . import engine
from .views import ctes, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Fixed values for the queries.
CLOCK = "2024-01-31 00:00:00"
BLOCKED = ("example.net", "thst.example.com")
ALLOWED = ("example.com", "example.org")
WHOLE = 1 << 20  # chunk limit under which every paragraph is one chunk


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- SQL fragments -------------------------------------------------------------------------------

NORM = """(SELECT scheme || '://' || lower(authority) || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
  || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_transform(list_sort(list_transform(ps, lambda p, i: struct_pack(k := split_part(p, '=', 1), i := i, v := CASE WHEN instr(p, '=') > 0 THEN p ELSE p || '=' END))), lambda s: s.v), '&') ELSE '' END
  FROM (SELECT lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
        regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
        list_filter(string_split(regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid','msclkid','mc_cid','mc_eid','_ga'], split_part(p, '=', 1))) AS ps))"""
HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1))"
PATH = "(CASE WHEN regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END || CASE WHEN regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1) <> '' THEN '?' || regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1) ELSE '' END)"


def norm(u: str = "url") -> str:
    return NORM.replace("{u}", u)


def host(u: str = "url") -> str:
    return HOST.replace("{u}", u)


def matches(patterns: tuple[str, ...], u: str = "url") -> str:
    return f"len(list_filter({literal(patterns)}, lambda p: {host(u)} = p OR ends_with({host(u)}, '.' || p))) > 0"


def assess(h: str = "html") -> dict[str, str]:
    text = f"trim(regexp_replace(regexp_replace({h}, '<[^>]*>', ' ', 'g'), '[\\s\\x0B\\x85\\p{{Z}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
    length = f"strlen({text})"
    scripts = f"len(regexp_extract_all({h}, '(?i)<script[\\s>]'))"
    root = f"regexp_matches({h}, '(?i)<div\\s+id=[\"''](root|app|__next)[\"'']\\s*>\\s*</div>')"
    noscript = f"len(list_filter(regexp_extract_all({h}, '(?i)<noscript[^>]*>([^\\n]*?)</noscript>', 1), lambda x: regexp_matches(lower(x), 'enable javascript|requires javascript|javascript is required|javascript must be enabled'))) > 0"
    ratio = f"(CASE WHEN strlen({h}) > 0 THEN {length}::DOUBLE / strlen({h}) ELSE 0 END)"
    return {
        "text_length": f"CAST({length} AS INT)", "text_ratio": f"round({ratio}, 9)", "has_noscript_warning": noscript, "has_empty_root": root, "script_tags": f"CAST({scripts} AS INT)",
        "ssr_framework": f"CASE WHEN contains({h}, '__NEXT_DATA__') THEN 'nextjs' WHEN contains({h}, '__NUXT__') THEN 'nuxt' WHEN contains({h}, '___gatsby') THEN 'gatsby' ELSE '' END",
        "needs_js": f"(({length} < 200 AND {scripts} > 5) OR {root} OR {noscript} OR ({ratio} < 0.05 AND {length} < 500))",
    }


BOT = "CASE WHEN regexp_matches({h}, '(?i)<title>\\s*(403|forbidden|access denied|blocked)\\s*</title>') THEN '403' WHEN regexp_matches({h}, '(?i)(cloudflare|cf-chl-bypass|ray\\s*id|checking your browser)') THEN 'cloudflare' WHEN regexp_matches({h}, '(?i)(captcha|recaptcha|hcaptcha|challenge-form)') THEN 'captcha' ELSE '' END"

# --- search --------------------------------------------------------------------------------------


@query(f"SELECT page_id, {norm()} AS norm_url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


@query(f"SELECT page_id, {host()} AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_host(F.col("url")).alias("host"))


@query(ctes("search_results") + " SELECT request_id, position, url, title, snippet, engine, score, category FROM search_results")
def search_scan(spark, sf_dir):
    """Results written as JSON responses, one a request, and read back."""
    rows = view(spark, sf_dir, "search_results")
    item = F.struct("position", "url", "title", F.col("snippet").alias("content"), "engine", "engines", "score", "category")
    bodies = rows.groupBy("request_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("results"))).alias("body"))
    return search.read_responses(bodies).drop("engines")


_ENGINES = """CASE (CASE WHEN coalesce(category, '') = '' THEN 'general' ELSE category END)
  WHEN 'news' THEN 'google news,duckduckgo,bing news' WHEN 'code' THEN 'github,stackoverflow,duckduckgo' WHEN 'science' THEN 'google scholar,duckduckgo,wikipedia' ELSE 'google,duckduckgo,brave' END"""
_ENC = "replace(replace(url_encode({x}), '%20', '+'), '*', '%2A')"


@query(
    ctes("requests")
    + f""" SELECT request_id, 'http://localhost:8080/search?' || CASE WHEN category <> '' THEN 'categories=' || {_ENC.format(x="category")} || '&' ELSE '' END || 'engines=' || {_ENC.format(x=_ENGINES)}
    || '&format=json&language=' || CASE WHEN language = '' THEN 'en' ELSE language END || '&pageno=' || CAST(greatest(page_no, 1) AS VARCHAR) || '&q=' || {_ENC.format(x="query")} || '&safesearch=1'
    || CASE WHEN time_range <> '' THEN '&time_range=' || time_range ELSE '' END AS request_url FROM requests"""
)
def search_request_url(spark, sf_dir):
    categories = F.when(F.col("category") != "", F.array("category")).otherwise(F.array().cast("array<string>"))
    url = search.request_url(F.col("query"), search.engine_route(F.col("category")), categories, F.col("language"), F.col("time_range"), F.col("page_no"))
    return view(spark, sf_dir, "requests").select("request_id", url.alias("request_url"))


@query(ctes("requests") + f" SELECT request_id, {_ENGINES} AS engines FROM requests")
def engine_route(spark, sf_dir):
    return view(spark, sf_dir, "requests").select("request_id", F.array_join(search.engine_route(F.col("category")), ",").alias("engines"))


@query(ctes("requests") + " SELECT request_id, CASE WHEN category = '' THEN 'general' ELSE category END AS category, CASE WHEN language = '' THEN 'en' ELSE language END AS language, CAST(CASE WHEN max_results <= 0 THEN 5 ELSE least(max_results, 20) END AS INT) AS max_results FROM requests")
def request_defaults(spark, sf_dir):
    return search.request_defaults(view(spark, sf_dir, "requests")).select("request_id", "category", "language", "max_results")


@query(ctes("search_results") + " SELECT request_id, position, url, score FROM search_results WHERE position <= 10")
def search_trim(spark, sf_dir):
    return search.trim_responses(view(spark, sf_dir, "search_results")).select("request_id", "position", "url", "score")


@query(ctes("search_results") + " SELECT request_id, position, array_to_string(list_sort(list_distinct(list_concat(engines, ['brave', 'google']))), ',') AS engines FROM search_results")
def engine_union(spark, sf_dir):
    rows = view(spark, sf_dir, "search_results")
    return rows.select("request_id", "position", F.array_join(search.engine_union(F.col("engines"), F.array(F.lit("brave"), F.lit("google"))), ",").alias("engines"))


_MERGED = (
    ctes("search_results")
    + f""", keyed AS (SELECT *, {norm()} AS norm_url FROM search_results),
merged AS (SELECT request_id, norm_url, min(position) AS first_position, max(score) AS score, count(*) AS n_merged, arg_max(snippet, strlen(snippet) * 1000000 - position) AS snippet,
  array_to_string(list_sort(list_distinct(flatten(list(engines)))), ',') AS engines FROM keyed GROUP BY request_id, norm_url),
deduped AS (SELECT m.request_id, CAST(row_number() OVER (PARTITION BY m.request_id ORDER BY first_position) AS INT) AS position, k.url, m.norm_url, k.title, m.snippet, k.engine, m.engines, m.score, k.category, m.n_merged
  FROM merged m JOIN keyed k ON k.request_id = m.request_id AND k.position = m.first_position)"""
)


def deduped(spark, sf_dir):
    return search.merge_duplicates(view(spark, sf_dir, "search_results"))


@query(_MERGED + " SELECT * FROM deduped")
def search_dedup(spark, sf_dir):
    return deduped(spark, sf_dir).withColumn("engines", F.array_join("engines", ","))


@query(_MERGED + " SELECT request_id, position, url FROM deduped WHERE position <= 7")
def pre_scrape_limit(spark, sf_dir):
    return search.limit_results(deduped(spark, sf_dir), 7).select("request_id", "position", "url")


# --- policy --------------------------------------------------------------------------------------


@query(ctes("search_results") + f" SELECT request_id, position, url FROM search_results WHERE {host()} = '' OR NOT ({matches(BLOCKED)})")
def domain_block(spark, sf_dir):
    rows = view(spark, sf_dir, "search_results")
    return rows.where(policy.domain_allowed(F.col("url"), Policy(blocklist=BLOCKED))).select("request_id", "position", "url")


@query(ctes("search_results") + f" SELECT request_id, position, url FROM search_results WHERE {host()} = '' OR ({matches(ALLOWED)})")
def domain_allow(spark, sf_dir):
    rows = view(spark, sf_dir, "search_results")
    return rows.where(policy.domain_allowed(F.col("url"), Policy(domain_mode="allowlist", allowlist=ALLOWED))).select("request_id", "position", "url")


def _domains(spark, values):
    return spark.createDataFrame([(v,) for v in values], "domain string")


@query(SQL["domain_block"])
def domain_block_join(spark, sf_dir):
    return policy.block_domains(view(spark, sf_dir, "search_results"), _domains(spark, BLOCKED)).select("request_id", "position", "url")


@query(SQL["domain_allow"])
def domain_allow_join(spark, sf_dir):
    return policy.allow_domains(view(spark, sf_dir, "search_results"), _domains(spark, ALLOWED)).select("request_id", "position", "url")


# lines, groups by runs of agents, the rules of the longest name, and the longest rule of those that match
_ROBOTS = r"""lines AS (SELECT host, i, lower(trim(split_part(l, ':', 1))) AS k, trim(substr(l, instr(l, ':') + 1)) AS v
  FROM (SELECT host, generate_subscripts(string_split(body, chr(10)), 1) AS i, regexp_replace(unnest(string_split(body, chr(10))), '#.*', '') AS l FROM robots WHERE status BETWEEN 200 AND 299)
  WHERE instr(l, ':') > 0 AND lower(trim(split_part(l, ':', 1))) IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
runs AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY host ORDER BY i), '') AS before FROM lines),
grouped AS (SELECT *, sum(CASE WHEN k = 'user-agent' AND before <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY i) AS g FROM runs),
bad AS (SELECT DISTINCT host FROM grouped WHERE g = 0),
agents AS (SELECT DISTINCT host, g, lower(v) AS name FROM grouped WHERE k = 'user-agent'),
own AS (SELECT host, arg_max(name, CASE WHEN name = '*' THEN 0 ELSE length(name) END) AS name FROM agents WHERE name = '*' OR (name <> '' AND starts_with('weftline', name)) GROUP BY host),
rules AS (SELECT r.host, r.k = 'allow' AS allow, CASE WHEN left(r.v, 1) IN ('/', '*') THEN r.v ELSE '/' || r.v END AS p
  FROM grouped r JOIN agents a ON a.host = r.host AND a.g = r.g JOIN own o ON o.host = a.host AND o.name = a.name WHERE r.k IN ('allow', 'disallow') AND r.v <> ''),
patterns AS (SELECT host, allow, strlen(p) AS size, '^' || regexp_replace(replace(regexp_replace(p, '([.?+()\[\]{}^|$])', '\\\1', 'g'), '*', '.*'), '\\\$$', '$') AS re FROM rules),
paths AS (SELECT DISTINCT {host} AS h, {path} AS path FROM search_results s),
ruled AS (SELECT h, path, arg_max(allow, size * 2 + CAST(allow AS INT)) AS allow FROM paths JOIN patterns r ON r.host = h AND regexp_matches(path, re) GROUP BY h, path),
robots_marked AS (SELECT s.*, coalesce(b.status BETWEEN 400 AND 499 OR (b.status = 200 AND bad.host IS NULL), FALSE) AS robots_checked,
  coalesce(bad.host IS NOT NULL OR u.allow, TRUE) AS robots_allowed
  FROM search_results s LEFT JOIN robots b ON b.host = {host} LEFT JOIN bad ON bad.host = b.host LEFT JOIN ruled u ON u.h = {host} AND u.path = {path})""".replace("{host}", host("s.url")).replace("{path}", PATH.replace("{u}", "s.url"))


@query(ctes("search_results", "robots") + f", {_ROBOTS} SELECT request_id, position, url, robots_checked, robots_allowed FROM robots_marked")
def robots_filter(spark, sf_dir):
    rows = policy.with_robots(view(spark, sf_dir, "search_results"), view(spark, sf_dir, "robots"))
    return rows.select("request_id", "position", "url", "robots_checked", "robots_allowed")


@query(ctes("search_results") + f" SELECT request_id, position, url, {host()} = '' OR row_number() OVER (PARTITION BY request_id, {host()} ORDER BY position) <= 2 AS rate_allowed FROM search_results")
def rate_limit_request(spark, sf_dir):
    return policy.request_quota(view(spark, sf_dir, "search_results"), 2).select("request_id", "position", "url", "rate_allowed")


@query("""WITH RECURSIVE v AS (SELECT event_id, 'h' || CAST(user_id % 7 AS VARCHAR) AS host, ts, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, host, ts, k, ts AS opened, 1 AS used, TRUE AS allowed FROM v WHERE k = 1
  UNION ALL SELECT v.event_id, v.host, v.ts, v.k, CASE WHEN epoch_us(v.ts) - epoch_us(w.opened) >= 60000000 THEN v.ts ELSE w.opened END,
    CASE WHEN epoch_us(v.ts) - epoch_us(w.opened) >= 60000000 THEN 1 ELSE w.used + CASE WHEN w.used < 1 THEN 1 ELSE 0 END END,
    epoch_us(v.ts) - epoch_us(w.opened) >= 60000000 OR w.used < 1 FROM w JOIN v ON v.host = w.host AND v.k = w.k + 1)
SELECT event_id, host, allowed FROM w""")
def rate_limit_anchored(spark, sf_dir):
    visits = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("host"), "ts")
    return policy.anchored_quota(visits, 1).select("event_id", "host", "allowed")


FUNNEL = Policy(blocklist=BLOCKED, requests_per_minute=2)
_FUNNEL = (
    ctes("search_results", "robots")
    + f""", {_ROBOTS},
left_over AS (SELECT *, NOT ({host()} <> '' AND {matches(BLOCKED)}) AS domain_ok FROM robots_marked),
stepped AS (SELECT *, CASE WHEN NOT domain_ok THEN 'domain' WHEN NOT robots_allowed THEN 'robots'
  WHEN NOT ({host()} = '' OR row_number() OVER (PARTITION BY request_id, {host()}, domain_ok AND robots_allowed ORDER BY position) <= 2) THEN 'rate' ELSE 'pass' END AS policy_step FROM left_over)"""
)


def stepped(spark, sf_dir):
    return policy.funnel(view(spark, sf_dir, "search_results"), view(spark, sf_dir, "robots"), FUNNEL)


@query(_FUNNEL + " SELECT request_id, count(*) FILTER (policy_step = 'domain') AS domain_dropped, count(*) FILTER (policy_step = 'robots') AS robots_blocked, count(*) FILTER (policy_step = 'rate') AS rate_limited, count(*) FILTER (policy_step = 'pass') AS results_after FROM stepped GROUP BY request_id")
def policy_funnel(spark, sf_dir):
    return policy.funnel_counts(stepped(spark, sf_dir))


@query(_FUNNEL + " SELECT request_id, position, url, policy_step FROM stepped")
def policy_partition(spark, sf_dir):
    """Every result with the step that dropped it, or pass: a partition of the input."""
    return stepped(spark, sf_dir).select("request_id", "position", "url", "policy_step")


# --- pages ---------------------------------------------------------------------------------------


@query("SELECT page_id, url, CAST(least(strlen(html), 5242880) AS INT) AS n_bytes, sha256(html) AS html_hash FROM pages")
def page_scan(spark, sf_dir):
    rows = scrape.read_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", F.octet_length("html").alias("n_bytes"), F.sha2("html", 256).alias("html_hash"))


_A = assess()


@query(ctes("l0") + " SELECT page_id, " + ", ".join(f"{x} AS {c}" for c, x in _A.items()) + " FROM l0 WHERE html IS NOT NULL")
def content_assess(spark, sf_dir):
    rows = view(spark, sf_dir, "l0").where("html is not null").select("page_id", H.content_assessment(F.col("html")).alias("a"))
    return rows.select("page_id", *[(F.round("a.text_ratio", 9) if c == "text_ratio" else F.col(f"a.{c}")).alias(c) for c in _A])


@query(ctes("rendered") + f" SELECT page_id, level, {BOT.replace('{h}', 'html')} AS signal FROM rendered")
def bot_detect(spark, sf_dir):
    return view(spark, sf_dir, "rendered").select("page_id", "level", H.bot_signal(F.col("html")).alias("signal"))


_ESC = f"CASE WHEN html IS NULL THEN TRUE ELSE {_A['needs_js']} END"


@query(ctes("l0") + f" SELECT page_id, url, {_ESC} AS escalate FROM l0")
def escalation_plan(spark, sf_dir):
    return scrape.escalation(view(spark, sf_dir, "l0")).select("page_id", "url", "escalate")


@query(
    ctes("l0", "rendered")
    + f""", judged AS (SELECT page_id, url, html, {_ESC} AS escalate FROM l0),
j AS (SELECT a.*, b.html AS l1, c.html AS l2, {BOT.replace("{h}", "b.html")} <> '' AS b1, {BOT.replace("{h}", "c.html")} <> '' AS b2
  FROM judged a LEFT JOIN rendered b ON b.page_id = a.page_id AND b.level = 1 LEFT JOIN rendered c ON c.page_id = a.page_id AND c.level = 2),
o AS (SELECT *, CASE WHEN NOT escalate THEN NULL WHEN l1 IS NULL AND html IS NULL THEN 'l0 and l1 failed' WHEN l1 IS NULL THEN 'l1 failed' WHEN b1 AND l2 IS NULL THEN 'l2 failed' WHEN b1 AND b2 THEN 'l2 blocked' END AS error FROM j)
SELECT page_id, CAST(CASE WHEN NOT escalate THEN 0 WHEN error IS NOT NULL THEN NULL WHEN b1 THEN 2 ELSE 1 END AS INT) AS level, error,
  sha256(CASE WHEN NOT escalate THEN html WHEN error IS NOT NULL THEN NULL WHEN b1 THEN l2 ELSE l1 END) AS html_hash FROM o"""
)
def scrape_merge(spark, sf_dir):
    return scrape.merge_levels(view(spark, sf_dir, "l0"), view(spark, sf_dir, "rendered")).select("page_id", "level", "error", F.sha2("html", 256).alias("html_hash"))


@query()
def extract_article(spark, sf_dir):
    return extract.extract_articles(table(spark, sf_dir, "pages")).select("page_id", "title", "text", "excerpt", "site")


@query()
def extract_markdown(spark, sf_dir):
    return extract.extract_articles(table(spark, sf_dir, "pages")).select("page_id", "markdown")


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), repeat(chr(10), 4)), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B\x85\p{Z}]+', ''), '[\s\x0B\x85\p{Z}]+$', '')) AS collapsed_hash FROM documents")
def blank_collapse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha2(T.blank_collapse(F.replace("text", F.lit("\n"), F.lit("\n" * 4))), 256).alias("collapsed_hash"))


# --- personal data -------------------------------------------------------------------------------


def _sql_ok(m: str, r: pii.Recogniser) -> str:
    if r.check == "luhn":
        d = f"regexp_replace({m}, '[ -]', '', 'g')"
        digit = f"CAST(substr({d}, length({d}) - i, 1) AS INT)"
        return f"(list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END ELSE {digit} END)) % 10 = 0)"
    if r.check == "licence":
        d = [f"CAST(substr({m}, {k + 3}, 1) AS INT)" for k in range(7)]
        return f"(({d[0]} + {d[2]} + {d[4]} + 2 * ({d[1]} + {d[3]} + {d[5]})) % 10 = {d[6]})"
    return "TRUE"


def _pii_ctes(recognisers: list[pii.Recogniser], text: str = "text") -> str:
    """found: all matches of each recogniser alone; spans: those that the sweep keeps, one after the other by rank."""
    spans = []
    for k, r in enumerate(recognisers):
        z = f"list_zip(string_split_regex(text, '{r.pattern}'), regexp_extract_all(text, '{r.pattern}'))"
        cell = f"SELECT doc_id, unnest(list_transform(z, lambda x, i: struct_pack(m := x[2], start := list_sum(list_transform(z[1:i], lambda y: length(y[1]) + coalesce(length(y[2]), 0))) - coalesce(length(x[2]), 0)))) AS s FROM (SELECT doc_id, {z} AS z FROM texts) WHERE len(z) > 1"
        spans.append(f"SELECT doc_id, '{r.entity}' AS entity_type, CAST(s.start AS INT) AS start, CAST(s.start + length(s.m) AS INT) AS stop, CAST({r.score} AS DOUBLE) AS score, {k} AS priority FROM ({cell}) WHERE s.m IS NOT NULL AND {_sql_ok('s.m', r)}")
    return f"""WITH RECURSIVE texts AS (SELECT doc_id, {text} AS text FROM documents), found AS ({" UNION ALL ".join(spans)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, stop - start DESC, start, priority) AS r FROM found),
sweep AS (SELECT doc_id, r, entity_type, start, stop, score, TRUE AS keep, [struct_pack(a := start, b := stop)] AS held FROM ranked WHERE r = 1
  UNION ALL SELECT x.doc_id, x.r, x.entity_type, x.start, x.stop, x.score, len(list_filter(held, lambda h: x.start < h.b AND h.a < x.stop)) = 0,
    CASE WHEN len(list_filter(held, lambda h: x.start < h.b AND h.a < x.stop)) = 0 THEN list_append(held, struct_pack(a := x.start, b := x.stop)) ELSE held END
  FROM sweep s JOIN ranked x ON x.doc_id = s.doc_id AND x.r = s.r + 1),
spans AS (SELECT doc_id, entity_type, start, stop AS "end", score FROM sweep WHERE keep)"""


_PII = _pii_ctes(pii.chosen(PII()))
_COUNTS = ", per AS (SELECT d.doc_id, d.text, count(s.doc_id) AS n, CASE WHEN strlen(d.text) > 0 THEN count(s.doc_id)::DOUBLE / strlen(d.text) * 1000 ELSE 0 END AS density FROM documents d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.text)"


def _pii_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


@query(_PII + " SELECT * FROM spans")
def pii_entities(spark, sf_dir):
    return pii.detect(_pii_docs(spark, sf_dir)).select("doc_id", F.inline("entities"))


_NAME = pii.Recogniser("PERSON", r"\b[A-Z][a-z]+ [A-Z0-9][a-z0-9-]+\b", 0.7)


def name_detector():
    """A detector of two capitalised words for the queries; it fails for texts with a count of characters divisible by 50."""
    import re

    pattern = re.compile(_NAME.pattern, re.ASCII)

    def look(texts: list[str], language: str) -> list:
        if any(len(t) % 50 == 0 for t in texts):
            raise RuntimeError("no answer")
        return [[("PERSON", *m.span(), _NAME.score) for m in pattern.finditer(t)] + [("NOT_ASKED_FOR", 0, 1, 1.0)] for t in texts]

    return look


def _marked(text: str = "text") -> str:
    """Texts with numbers that several recognisers take: a licence, one with a wrong digit, and a card that begins like a phone number."""
    return f"{text} || ' Licence AB1234563 not AB1234567, Dr BC9876541, card 4111 1111 1111 1111, Anna 555-123-4567.'"


@query(_pii_ctes([*pii.chosen(PII()), _NAME], _marked()) + " SELECT * FROM spans WHERE doc_id NOT IN (SELECT doc_id FROM texts WHERE length(text) % 50 = 0)")
def pii_detectors(spark, sf_dir):
    """Recognisers and a detector whose spans clash; texts for which the detector fails have none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_marked()).alias("content"))
    return pii.detect(rows, detectors=[name_detector]).select("doc_id", F.inline("entities"))


@query(_PII + _COUNTS + " SELECT doc_id, doc_id % 5 <> 0 AS pii_checked, CASE WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'pass' END AS pii_action, CAST(CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n END AS INT) AS entity_count FROM per")
def pii_dispatch(spark, sf_dir):
    """Every fifth detector call counts as failed."""
    found = pii.detect(_pii_docs(spark, sf_dir))
    found = found.withColumn("entities", F.when(F.col("doc_id") % 5 != 0, F.col("entities")))
    return pii.process(found).select("doc_id", "pii_checked", "pii_action", "entity_count")


@query(_PII + " SELECT doc_id, entity_type AS type, round(avg(score), 6) AS score, CAST(count(*) AS INT) AS count FROM spans GROUP BY ALL")
def pii_audit(spark, sf_dir):
    rows = pii.process(_pii_docs(spark, sf_dir)).select("doc_id", F.inline("pii_audit"))
    return rows.select("doc_id", "type", F.round("score", 6).alias("score"), "count")


def _redacted_sql() -> str:
    new = "CASE entity_type WHEN 'PHONE_NUMBER' THEN '<PHONE>' WHEN 'EMAIL_ADDRESS' THEN repeat('*', least(100, \"end\" - start)) || substr(text, start + 101, greatest(0, \"end\" - start - 100)) ELSE '<REDACTED>' END"
    return f"""placed AS (SELECT s.*, text, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM spans s JOIN texts USING (doc_id)),
changed AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || {new}, '' ORDER BY start) || substr(any_value(text), max("end") + 1) AS t FROM placed GROUP BY doc_id),
redacted AS (SELECT doc_id, coalesce(c.t, x.text) AS t FROM texts x LEFT JOIN changed c USING (doc_id))"""


@query(_PII + _COUNTS + f", {_redacted_sql()} SELECT p.doc_id, CASE WHEN n > 0 THEN 'redacted' ELSE 'pass' END AS pii_action, sha256(r.t) AS content_hash FROM per p JOIN redacted r USING (doc_id)")
def pii_redact(spark, sf_dir):
    rows = pii.process(_pii_docs(spark, sf_dir), PII(mode="redact"))
    return rows.select("doc_id", "pii_action", F.sha2("content", 256).alias("content_hash"))


@query(_PII + _COUNTS + f", {_redacted_sql()} SELECT p.doc_id, density > 1.5 AS pii_blocked, CASE WHEN density > 1.5 THEN 'blocked' WHEN n > 0 THEN 'redacted' ELSE 'pass' END AS pii_action, CASE WHEN density > 1.5 THEN 'block' ELSE 'redact' END AS pii_mode, round(density, 6) AS density, sha256(CASE WHEN density > 1.5 THEN '' ELSE r.t END) AS content_hash FROM per p JOIN redacted r USING (doc_id)")
def pii_block(spark, sf_dir):
    rows = pii.process(_pii_docs(spark, sf_dir), PII(mode="block", max_density=1.5))
    return rows.select("doc_id", "pii_blocked", "pii_action", "pii_mode", F.round("pii_density", 6).alias("density"), F.sha2("content", 256).alias("content_hash"))


# --- injection -----------------------------------------------------------------------------------

_SCORE = "CASE WHEN contains(lower(t), 'ignore previous') OR contains(lower(t), 'ignore all previous') OR contains(lower(t), 'disregard previous') OR contains(lower(t), 'disregard the above') THEN 0.97::DOUBLE WHEN contains(lower(t), 'system prompt') OR contains(lower(t), 'you are now') OR contains(lower(t), 'reveal your') OR contains(lower(t), 'developer mode') OR contains(lower(t), 'jailbreak') THEN 0.6::DOUBLE ELSE 0.02::DOUBLE END"
_CHUNKS = (
    ctes("para_docs")
    + f""", parts AS (SELECT doc_id, content, unnest(string_split(content, chr(10) || chr(10))) AS t, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS i FROM para_docs),
placed AS (SELECT *, sum(strlen(t) + 2) OVER (PARTITION BY doc_id ORDER BY i) - strlen(t) - 2 AS off FROM parts),
chunks AS (SELECT doc_id, content, t, off, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS idx FROM placed WHERE regexp_matches(t, '[^\\s\\x0B\\x85\\p{{Z}}]')),
scored AS (SELECT *, {_SCORE} AS score FROM chunks)""".replace("{{", "{").replace("}}", "}")
)
WHOLE_CHUNKS = Injection(enabled=True, max_chunk_bytes=WHOLE)


def _with(mode: str) -> Injection:
    return Injection(enabled=True, mode=mode, max_chunk_bytes=WHOLE)


# paragraphs, lines of the long ones, a fold over their lines (a buffer's start and size, and the buffer that it closes), hard cuts of the last
_GREEDY = r"""WITH RECURSIVE paragraphs AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS p FROM documents),
placed AS (SELECT doc_id, p, t, sum(strlen(t) + 2) OVER (PARTITION BY doc_id ORDER BY p) - strlen(t) - 2 AS off FROM paragraphs),
full_ AS (SELECT * FROM placed WHERE regexp_matches(t, '[^\s\x0B\x85\p{Z}]')),
cut AS (SELECT doc_id, p, off, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM full_ WHERE strlen(t) > 1200),
lines AS (SELECT doc_id, p, k, strlen(l) AS n, off + sum(strlen(l) + 1) OVER (PARTITION BY doc_id, p ORDER BY k) - strlen(l) - 1 AS pos, count(*) OVER (PARTITION BY doc_id, p) AS last FROM cut),
fold AS (SELECT doc_id, p, k, last, pos, n, CAST(NULL AS HUGEINT) AS done_pos, CAST(NULL AS BIGINT) AS done_n FROM lines WHERE k = 1
  UNION ALL SELECT l.doc_id, l.p, l.k, l.last, CASE WHEN f.n > 0 AND f.n + 1 + l.n <= 1200 THEN f.pos ELSE l.pos END, CASE WHEN f.n > 0 AND f.n + 1 + l.n <= 1200 THEN f.n + 1 + l.n ELSE l.n END,
    CASE WHEN f.n > 0 AND f.n + 1 + l.n > 1200 THEN f.pos END, CASE WHEN f.n > 0 AND f.n + 1 + l.n > 1200 THEN f.n END
  FROM fold f JOIN lines l ON l.doc_id = f.doc_id AND l.p = f.p AND l.k = f.k + 1),
found AS (SELECT doc_id, off AS pos, strlen(t) AS n FROM full_ WHERE strlen(t) <= 1200 UNION ALL SELECT doc_id, done_pos, done_n FROM fold WHERE done_pos IS NOT NULL
  UNION ALL SELECT doc_id, pos + g, least(1200, n - g) FROM (SELECT doc_id, pos, n, unnest(range(0, n, 1200)) AS g FROM fold WHERE k = last))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS idx, CAST(pos AS INT) AS byte_offset, CAST(n AS INT) AS length, sha256(encode(text)[CAST(pos AS BIGINT) + 1:CAST(pos + n AS BIGINT)]) AS chunk_hash
FROM found JOIN documents USING (doc_id)"""


@query(_GREEDY)
def inj_chunks(spark, sf_dir):
    """Chunks of all documents at the default limit; long paragraphs are packed by lines, and hashed by their bytes."""
    rows = injection.with_chunks(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))
    hashed = lambda data: F.transform("chunks", lambda c: F.struct(c["index"].alias("idx"), c["byte_offset"].alias("byte_offset"), c["length"].alias("length"), F.sha2(F.substring(data, c["byte_offset"] + 1, c["length"]), 256).alias("chunk_hash")))
    return evaluated(rows.select("doc_id", let(F.encode("content", "UTF-8"), hashed).alias("c")), "c").select("doc_id", F.inline("c"))


@query(_CHUNKS + " SELECT doc_id, idx, CAST(off AS INT) AS byte_offset, CAST(strlen(t) AS INT) AS length, sha256(t) AS text_hash FROM chunks")
def inj_chunks_paragraphs(spark, sf_dir):
    rows = injection.with_chunks(view(spark, sf_dir, "para_docs"), WHOLE).select("doc_id", F.inline("chunks"))
    return rows.select("doc_id", F.col("index").alias("idx"), "byte_offset", "length", F.sha2("text", 256).alias("text_hash"))


@query(ctes("search_results") + " SELECT request_id, position, CASE WHEN position % 3 = 0 THEN 0.0 ELSE score END AS injection_score, CASE WHEN position % 3 = 0 THEN greatest(score, 0.4) ELSE 1 - score END AS benign_score FROM search_results")
def inj_pick_scores(spark, sf_dir):
    """Labels in any case, the last one wins; a missing label scores 0."""
    pair = lambda name, s: F.struct(F.lit(name).alias("label"), s.alias("score"))
    own = F.array(pair("INJECTION", F.lit(0.5)), pair("injection", F.col("score")), pair("LEGIT", 1 - F.col("score")))
    other = F.array(pair("LEGIT", F.col("score")), pair("OTHER", F.lit(0.4)))
    labels = F.when(F.col("position") % 3 == 0, other).otherwise(own)
    return view(spark, sf_dir, "search_results").select("request_id", "position", F.inline(F.array(injection.pick_scores(labels))))


@query(_CHUNKS + " SELECT doc_id, idx, score AS injection_score, score > 0.85 AS over_threshold FROM scored")
def inj_scores(spark, sf_dir):
    rows = injection.score_chunks(injection.with_chunks(view(spark, sf_dir, "para_docs"), WHOLE), WHOLE_CHUNKS)
    return evaluated(rows.select("doc_id", "chunk_scores"), "chunk_scores").select("doc_id", F.inline("chunk_scores")).select("doc_id", F.col("index").alias("idx"), "injection_score", "over_threshold")


def phrase_model():
    """A model of two labels for the queries: told phrases, in both cases of its label; it fails for texts with a count of bytes divisible by 97."""

    def answer(texts: list[str]) -> list:
        if any(len(t.encode()) % 97 == 0 for t in texts):
            raise RuntimeError("no answer")
        scores = [0.97 if any(w in t.lower() for w in injection.STRONG) else 0.6 if any(w in t.lower() for w in injection.WEAK) else 0.02 for t in texts]
        return [[("INJECTION", 1.0), ("LEGIT", 1 - s), ("Injection", s), ("OTHER", 0.01)] for s in scores]

    return answer


@query(
    _CHUNKS
    + """, failing AS (SELECT DISTINCT doc_id FROM chunks WHERE strlen(t) % 97 = 0),
per AS (SELECT d.doc_id, f.doc_id IS NULL AS inj_checked, count(s.doc_id) AS n, count(*) FILTER (s.score > 0.85) AS over_n, max(s.score) AS top FROM para_docs d LEFT JOIN scored s ON s.doc_id = d.doc_id LEFT JOIN failing f ON f.doc_id = d.doc_id GROUP BY ALL)
SELECT doc_id, inj_checked, CASE WHEN NOT inj_checked THEN 'skipped' WHEN over_n > 0 THEN 'blocked' ELSE 'pass' END AS inj_action, CAST(n AS INT) AS chunk_count, CAST(CASE WHEN inj_checked THEN over_n ELSE 0 END AS INT) AS over_count,
  CASE WHEN inj_checked AND n > 0 THEN top ELSE 0 END AS max_score FROM per"""
)
def inj_classify(spark, sf_dir):
    """A model with label arrays over the different chunks; a chunk for which it fails leaves its document unchecked."""
    rows = injection.process(view(spark, sf_dir, "para_docs"), _with("block"), classifier=phrase_model)
    return rows.select("doc_id", "inj_checked", "inj_action", "chunk_count", "over_count", "max_score")


_PER = ", per AS (SELECT d.doc_id, d.content, count(s.doc_id) AS n, count(*) FILTER (s.score > 0.85) AS over_n, coalesce(max(s.score), 0) AS max_score, avg(s.score) AS mean_score FROM para_docs d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.content)"


@query(_CHUNKS + _PER + " SELECT doc_id, NOT (doc_id % 4 = 0 AND n > 0) AS inj_checked, CASE WHEN doc_id % 4 = 0 AND n > 0 THEN 'skipped' ELSE 'pass' END AS inj_action FROM per")
def inj_dispatch(spark, sf_dir):
    """The scorer fails for every fourth document."""
    rows = view(spark, sf_dir, "para_docs")
    failing = lambda text: F.when(F.col("doc_id") % 4 != 0, injection.keyword_score(text))
    return injection.process(rows, _with("audit"), scorer=failing).select("doc_id", "inj_checked", "inj_action")


@query(_CHUNKS + _PER + " SELECT doc_id, CAST(n AS INT) AS chunk_count, CAST(over_n AS INT) AS over_count, max_score::DOUBLE AS max_score, round(mean_score, 6) AS mean_score FROM per")
def inj_audit(spark, sf_dir):
    rows = injection.process(view(spark, sf_dir, "para_docs"), _with("audit"))
    return rows.select("doc_id", "chunk_count", "over_count", "max_score", F.round("mean_score", 6).alias("mean_score"))


_OPEN, _CLOSE = "<untrusted-content>' || chr(10) || '", "' || chr(10) || '</untrusted-content>"


@query(
    _CHUNKS
    + _PER
    + f""", pieces AS (SELECT p.doc_id, p.i, CASE WHEN s.score > 0.85 THEN '{_OPEN}' || p.t || '{_CLOSE}' ELSE p.t END AS t FROM placed p LEFT JOIN scored s ON s.doc_id = p.doc_id AND s.off = p.off),
marked AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM pieces GROUP BY doc_id)
SELECT doc_id, CASE WHEN over_n > 0 THEN 'annotated' ELSE 'pass' END AS inj_action, sha256(t) AS content_hash FROM per JOIN marked USING (doc_id)"""
)
def inj_annotate(spark, sf_dir):
    rows = injection.process(view(spark, sf_dir, "para_docs"), _with("annotate"))
    return rows.select("doc_id", "inj_action", F.sha2("content", 256).alias("content_hash"))


@query(_CHUNKS + _PER + " SELECT doc_id, over_n > 0 AS inj_blocked, CASE WHEN over_n > 0 THEN 'blocked' ELSE 'pass' END AS inj_action FROM per")
def inj_block(spark, sf_dir):
    return injection.process(view(spark, sf_dir, "para_docs"), _with("block")).select("doc_id", "inj_blocked", "inj_action")


# --- ranking -------------------------------------------------------------------------------------


def _scored(spark, sf_dir):
    return view(spark, sf_dir, "search_results").withColumn("idx", F.col("position") - 1)


@query(ctes("search_results") + " SELECT request_id, CAST(position - 1 AS INT) AS idx, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, position) AS rank FROM search_results) WHERE rank <= 5")
def rerank_topk(spark, sf_dir):
    return rank.top_k(_scored(spark, sf_dir), 5).select("request_id", "idx", "score", "rank")


@query(ctes("search_results") + " SELECT request_id, position, CAST(row_number() OVER (PARTITION BY request_id ORDER BY position) AS INT) AS rank, round(CAST(1 - (position - 1) * 0.01 AS DOUBLE), 9) AS score FROM search_results")
def rerank_noop(spark, sf_dir):
    return rank.rerank_none(view(spark, sf_dir, "search_results").drop("score")).select("request_id", "position", "rank", F.round("score", 9).alias("score"))


@query(ctes("search_results") + " SELECT request_id, CAST(position - 1 AS INT) AS idx, url, score * 2 AS new_score FROM search_results WHERE position % 3 <> 0")
def rerank_index_join(spark, sf_dir):
    """Scores for two of three documents, and for some that don't exist."""
    docs = _scored(spark, sf_dir)
    scores = docs.where("position % 3 <> 0").select("request_id", "idx", (F.col("score") * 2).alias("new_score"))
    scores = scores.unionByName(scores.withColumn("idx", F.col("idx") + 100_000))
    return rank.join_scores(docs.select("request_id", "idx", "url"), scores)


@query(ctes("search_results") + " SELECT request_id, CAST(position - 1 AS INT) AS idx, score FROM search_results WHERE request_id <> 'r3'")
def rerank_zip(spark, sf_dir):
    """One request's scores are one short, so it gets none."""
    rows = view(spark, sf_dir, "search_results").groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "score"))), lambda x: x["score"]).alias("s"), F.count("*").alias("n"))
    short = F.when(F.col("request_id") == "r3", F.slice("s", 1, F.size("s") - 1)).otherwise(F.col("s"))
    return rows.select("request_id", F.inline(rank.zip_scores(short, F.col("n"))))


@query(
    ctes("search_results")
    + """ SELECT request_id, position, CASE WHEN position % 4 = 2 THEN NULL ELSE 2 END AS n, CASE WHEN position % 4 = 2 THEN NULL ELSE least(1, greatest(0, round(score * 3 - 1, 2))) END AS first FROM search_results"""
)
def rerank_parse_scores(spark, sf_dir):
    """Answers with text around the array; every fourth is malformed."""
    answer = F.when(F.col("position") % 4 == 2, "[high, 0.5]").otherwise(F.concat(F.lit("Scores: ["), F.round(F.col("score") * 3 - 1, 2).cast("string"), F.lit(", 0.5]. Done")))
    parsed = rank.parse_scores(answer, F.lit(2))
    rows = view(spark, sf_dir, "search_results").withColumn("p", parsed)
    return rows.select("request_id", "position", F.when(F.col("p").isNotNull(), F.size("p")).alias("n"), F.element_at("p", 1).alias("first"))


@query(
    ctes("search_results")
    + """ SELECT request_id, sha256('Given the query: "' || request_id || '"' || repeat(chr(10), 2) || 'Score the relevance of each document on a scale of 0.0 to 1.0.' || chr(10)
    || 'Respond ONLY with a JSON array of scores in the same order as the documents.' || repeat(chr(10), 2) || string_agg('Document ' || CAST(position AS VARCHAR) || ': ' || CASE WHEN strlen(snippet) > 2000 THEN substr(snippet, 1, 2000) || '...' ELSE snippet END || chr(10), '' ORDER BY position) || chr(10) || 'Response format: [0.95, 0.23, 0.87]') AS prompt_hash
    FROM search_results GROUP BY request_id"""
)
def rerank_prompt(spark, sf_dir):
    rows = view(spark, sf_dir, "search_results").groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "snippet"))), lambda x: x["snippet"]).alias("docs"))
    return rows.select("request_id", F.sha2(rank.prompt(F.col("request_id"), F.col("docs")), 256).alias("prompt_hash"))


@query(
    ctes("search_results")
    + """ SELECT request_id, CAST(position - 1 AS INT) AS idx, CAST(rank AS INT) AS rank, round(CASE WHEN failed THEN 1 - (position - 1) * 0.01 ELSE score END, 9) AS score, CASE WHEN failed THEN 'none (fallback)' ELSE 'flashrank' END AS reranker
    FROM (SELECT *, request_id IN ('r1', 'r4') AS failed, CASE WHEN request_id IN ('r1', 'r4') THEN position ELSE row_number() OVER (PARTITION BY request_id ORDER BY score DESC, position) END AS rank FROM search_results)
    WHERE failed OR rank <= 5"""
)
def rerank_fallback(spark, sf_dir):
    """Two requests' scorers fail: original order, no top k."""
    rows = _scored(spark, sf_dir).withColumn("score", F.when(~F.col("request_id").isin("r1", "r4") | (F.col("idx") > 0), F.col("score")))
    return rank.with_fallback(rows, 5, "flashrank").select("request_id", "idx", "rank", F.round("score", 9).alias("score"), "reranker")


_WORDS_OF = "list_distinct(list_filter(string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(
    ctes("search_results")
    + f""", w AS (SELECT *, {_WORDS_OF.format(t="title || ' ' || snippet")} AS words FROM search_results),
s AS (SELECT *, len(list_filter(['the', 'of', 'la', 'de', 'en'], lambda q: list_contains(words, q)))::DOUBLE / 5 AS share FROM w)
SELECT request_id, CAST(position - 1 AS INT) AS idx, share AS score, CAST(rank AS INT) AS rank, 'lexical' AS reranker FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY share DESC, position) AS rank FROM s) WHERE rank <= 5"""
)
def rerank_lexical(spark, sf_dir):
    """An addition: the share of query words in each document, top k."""
    config = Rerank(provider="lexical", endpoint="builtin")
    rows = _scored(spark, sf_dir).withColumn("query", F.lit("the of la de en"))
    scorer = lambda docs: docs.withColumn("score", rank.lexical_score(F.col("query"), F.concat_ws(" ", "title", "snippet")))
    return rank.rerank(rows, config, {"lexical": scorer}).select("request_id", "idx", "score", "rank", "reranker")


def overlap_model():
    """A model of pairs for the queries: lengths by a formula, and no answer for passages of the tail of one engine's names."""

    def answer(queries: list[str], passages: list[str]) -> list[float]:
        if any(len(p) % 41 == 0 for p in passages):
            return []
        return [(7 * len(p) + 3 * len(q)) % 100 / 100 for q, p in zip(queries, passages, strict=True)]

    return answer


@query(
    ctes("search_results")
    + """, scored AS (SELECT *, CAST((7 * length(title) + 3 * length(request_id)) % 100 AS DOUBLE) / 100 AS s, bool_or(length(title) % 41 = 0) OVER (PARTITION BY request_id) AS failed FROM search_results)
SELECT request_id, CAST(position - 1 AS INT) AS idx, CAST(rank AS INT) AS rank, round(CASE WHEN failed THEN 1 - (position - 1) * 0.01 ELSE s END, 9) AS score, CASE WHEN failed THEN 'none (fallback)' ELSE 'kserve' END AS reranker
FROM (SELECT *, CASE WHEN failed THEN position ELSE row_number() OVER (PARTITION BY request_id ORDER BY s DESC, position) END AS rank FROM scored) WHERE failed OR rank <= 5"""
)
def rerank_tensor(spark, sf_dir):
    """Pairs of many requests in batches; a pair without an answer sends its request back to the original order."""
    rows = _scored(spark, sf_dir).drop("score").withColumn("query", F.col("request_id")).withColumn("content", F.col("title"))
    out = rank.rerank(rows, Rerank(provider="kserve", endpoint="builtin", top_k=5), {"kserve": rank.tensor_provider(overlap_model)})
    return out.select("request_id", "idx", "rank", F.round("score", 9).alias("score"), "reranker")


# --- provenance and format -----------------------------------------------------------------------

_BLOCK_CUT = "CASE WHEN strlen(snippet) > 5000 THEN substr(snippet, 1, 5000) || chr(10) || chr(10) || '... [truncated]' ELSE snippet END"
_CUT = "CASE WHEN strlen(text) > 5000 THEN encode(text)[1:5000] || encode(chr(10) || chr(10) || '... [truncated]') ELSE encode(text) END"


@query(f"SELECT doc_id, sha256(text) AS raw_hash, sha256(trim(text)) AS extracted_hash, sha256({_CUT}) AS final_hash FROM documents")
def hash_chain(spark, sf_dir):
    chain = provenance.hash_chain(F.col("text"), F.trim("text"), T.truncated_bytes(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(chain)))


@query(f"SELECT doc_id, sha256({_CUT}) AS final_hash, CAST(octet_length({_CUT}) AS INT) AS content_length, strlen(text) > 5000 AS cut FROM documents")
def truncate_hash(spark, sf_dir):
    data = T.truncated_bytes(F.col("text"))
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha2(data, 256).alias("final_hash"), F.octet_length(data).alias("content_length"), (F.octet_length("text") > T.MAX_CONTENT).alias("cut"))


def _delivered(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    rows = rows.select(F.concat(F.lit("q"), F.floor(F.col("doc_id") / 5).cast("string")).alias("request_id"), F.lit(CLOCK).cast("timestamp").alias("timestamp"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("raw"), F.trim("text").alias("markdown"), (F.col("doc_id") % 4).cast("int").alias("scraper_level"), F.lit("audit").alias("pii_mode"), (1.0 - (F.col("doc_id") % 5) * 0.01).alias("score"), (F.col("doc_id") % 5 + 1).cast("int").alias("rank"))
    return provenance.records(rows)


_CUT_MD = _CUT.replace("text", "trim(text)")
_RECORDS = f"""rec AS (SELECT 'q' || CAST(CAST(floor(doc_id / 5) AS BIGINT) AS VARCHAR) AS request_id, 'https://' || source || '.example/' || CAST(doc_id AS VARCHAR) AS url, CAST(doc_id % 4 AS INT) AS scraper_level,
  sha256(text) AS raw_html_hash, sha256(trim(text)) AS extracted_hash, sha256({_CUT_MD}) AS final_hash, CAST(octet_length({_CUT_MD}) AS BIGINT) AS content_length,
  CASE doc_id % 4 WHEN 0 THEN 'readability' WHEN 1 THEN 'cdp' WHEN 2 THEN 'cdp_stealth' ELSE 'unknown' END AS extraction_method, 'audit' AS pii_mode, 'pass' AS pii_action, 1 - (doc_id % 5) * 0.01 AS reranker_score, CAST(doc_id % 5 + 1 AS INT) AS reranker_rank FROM documents)"""


@query(f"WITH {_RECORDS} SELECT request_id, url, scraper_level, raw_html_hash, extracted_hash, final_hash, content_length, extraction_method, pii_mode, pii_action, round(reranker_score, 9)::DOUBLE AS reranker_score, reranker_rank FROM rec")
def provenance_records(spark, sf_dir):
    rows = _delivered(spark, sf_dir)
    return rows.select("request_id", "url", "scraper_level", "raw_html_hash", "extracted_hash", "final_hash", "content_length", "extraction_method", "pii_mode", "pii_action", F.round("reranker_score", 9).alias("reranker_score"), "reranker_rank")


QUERIES["provenance"], SQL["provenance"] = QUERIES.pop("provenance_records"), SQL.pop("provenance_records")


@query(
    f"""WITH {_RECORDS} SELECT url, sha256(concat_ws(chr(9), request_id, '2024-01-31 00:00:00.000', url, url, '0', '', CAST(scraper_level AS VARCHAR), raw_html_hash, extracted_hash, final_hash, CAST(content_length AS VARCHAR), extraction_method, pii_mode, pii_action, '0',
    printf('%.6f', reranker_score::DOUBLE), CAST(reranker_rank AS VARCHAR), 'false', 'false', '0', '0', '0')) AS line_hash FROM rec"""
)
def provenance_tsv(spark, sf_dir):
    rows = _delivered(spark, sf_dir)
    return rows.select("url", F.sha2(provenance.tsv(rows), 256).alias("line_hash"))


@query(ctes("provenance_log") + " SELECT event_id, url, reranker_score FROM provenance_log WHERE request_id = 'req17'")
def prov_by_request(spark, sf_dir):
    rows = view(spark, sf_dir, "provenance_log").withColumn("reranker_rank", F.row_number().over(_by_score()))
    return provenance.by_request(rows, "req17").select("event_id", "url", "reranker_score")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("request_id").orderBy(F.desc("reranker_score"), "event_id")


@query(ctes("provenance_log") + f" SELECT url, count(*) AS fetches, max(timestamp) AS last_seen FROM provenance_log WHERE timestamp > TIMESTAMP '{CLOCK}' - INTERVAL 24 HOUR AND timestamp <= TIMESTAMP '{CLOCK}' GROUP BY url ORDER BY fetches DESC, url LIMIT 100")
def prov_urls_24h(spark, sf_dir):
    rows = view(spark, sf_dir, "provenance_log")
    return provenance.urls_since(rows, CLOCK)


@query(ctes("provenance_log") + " SELECT url, count(DISTINCT raw_html_hash) AS versions, count(*) AS fetches FROM provenance_log GROUP BY url")
def prov_versions(spark, sf_dir):
    return provenance.versions(view(spark, sf_dir, "provenance_log"))


@query(ctes("provenance_log") + " SELECT event_id, url, raw_html_hash, previous_hash FROM (SELECT *, lag(raw_html_hash) OVER (PARTITION BY url ORDER BY timestamp, event_id) AS previous_hash FROM provenance_log) WHERE previous_hash <> raw_html_hash")
def prov_changes(spark, sf_dir):
    return provenance.changes(view(spark, sf_dir, "provenance_log")).select("event_id", "url", "raw_html_hash", "previous_hash")


@query(ctes("provenance_log") + " SELECT event_id, url FROM provenance_log WHERE timestamp >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY")
def prov_ttl(spark, sf_dir):
    return provenance.retained(view(spark, sf_dir, "provenance_log"), "2024-04-10 00:00:00").select("event_id", "url")


_SIDE = """ (SELECT request_id, url, count(*) AS {n} FROM provenance_log WHERE scraper_level {op} 0 GROUP BY request_id, url)"""


@query(ctes("provenance_log") + f" SELECT coalesce(a.request_id, b.request_id) AS request_id, coalesce(a.url, b.url) AS url, a.n_pii, b.n_inj FROM {_SIDE.format(n='n_pii', op='<>')} a FULL OUTER JOIN {_SIDE.format(n='n_inj', op='=')} b ON a.request_id = b.request_id AND a.url = b.url")
def audit_join(spark, sf_dir):
    rows = view(spark, sf_dir, "provenance_log")
    side = lambda c, n: rows.where(c).groupBy("request_id", "url").agg(F.count("*").alias(n))
    return provenance.join_audits(side("scraper_level <> 0", "n_pii"), side("scraper_level = 0", "n_inj"))


@query(
    ctes("search_results")
    + f""", b AS (SELECT request_id, position, url, '## ' || CAST(position AS VARCHAR) || '. ' || title || chr(10) || '**Source:** ' || url || chr(10) || '**Relevance:** ' || printf('%.2f', score) || repeat(chr(10), 2) || {_BLOCK_CUT} || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) AS block FROM search_results)
SELECT request_id, CAST(count(*) AS INT) AS n_results, sha256('# Search Results for: "' || request_id || '"' || repeat(chr(10), 2) || string_agg(block, '' ORDER BY position) || '**Sources:**' || chr(10) || string_agg('[' || CAST(position AS VARCHAR) || '] ' || url || chr(10), '' ORDER BY position)) AS content_hash FROM b GROUP BY request_id"""
)
def format_result(spark, sf_dir):
    rows = view(spark, sf_dir, "search_results").select("request_id", F.col("request_id").alias("query"), F.col("position").alias("rank"), "title", "url", "score", F.col("snippet").alias("markdown"))
    return fmt.format_results(rows).select("request_id", "n_results", F.sha2("content", 256).alias("content_hash"))


@query(ctes("provenance_log") + " SELECT request_id, bool_or(pii_action <> 'pass') AS any_pii, count(*) FILTER (pii_action = 'blocked') AS pii_blocked, count(*) FILTER (pii_action = 'redacted') AS pii_redacted, count(*) AS n FROM provenance_log GROUP BY request_id")
def request_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "provenance_log").groupBy("request_id")
    return rows.agg(F.bool_or(F.col("pii_action") != "pass").alias("any_pii"), F.count_if(F.col("pii_action") == "blocked").alias("pii_blocked"), F.count_if(F.col("pii_action") == "redacted").alias("pii_redacted"), F.count("*").alias("n"))


# --- telemetry -----------------------------------------------------------------------------------


@query(ctes("provenance_log") + " SELECT scraper_level, pii_action, CAST(count(*) AS BIGINT) AS total FROM provenance_log GROUP BY ALL")
def metrics_counters(spark, sf_dir):
    return telemetry.counters(view(spark, sf_dir, "provenance_log").withColumn("value", F.lit(1)), "scraper_level", "pii_action")


@query(ctes("provenance_log") + " SELECT scraper_level, " + ", ".join(f"count(*) FILTER (total_duration_ms <= {b}) AS le_{b}" for b in telemetry.BOUNDS) + ", count(total_duration_ms) AS n, CAST(sum(total_duration_ms) AS BIGINT) AS total, min(total_duration_ms) AS low, max(total_duration_ms) AS high FROM provenance_log GROUP BY scraper_level")
def metrics_histogram(spark, sf_dir):
    return telemetry.histogram(view(spark, sf_dir, "provenance_log"), "total_duration_ms", "scraper_level")


@query(ctes("provenance_log") + " SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, count(*) AS n, count(*) FILTER (pii_action = 'blocked') AS errors, count(*) FILTER (pii_action = 'blocked')::DOUBLE / count(*) AS error_rate FROM provenance_log GROUP BY 1")
def alert_error_rate(spark, sf_dir):
    return telemetry.error_rate(view(spark, sf_dir, "provenance_log"))


@query(ctes("provenance_log") + " SELECT event_id, request_id FROM provenance_log WHERE CAST('0x' || substr(sha256(request_id), 1, 8) AS BIGINT) < CAST(floor(0.25 * 4294967296) AS BIGINT)")
def trace_sample(spark, sf_dir):
    return telemetry.sampled(view(spark, sf_dir, "provenance_log"), 0.25).select("event_id", "request_id")


_FACTS = {
    "search.duration": "(event_id * 37) % 400", "scrape.duration": "total_duration_ms", "pii.duration": "(event_id * 53) % 300", "injection.duration": "(event_id % 7) * 100",
    "rerank.duration": "(event_id * 11) % 150", "pipeline.duration": "total_duration_ms + (event_id * 37) % 400 + (event_id * 53) % 300", "content.length": "(event_id * 7919) % 5000 - 10",
}
_FACTS_SQL = ctes("provenance_log") + ", facts AS (" + " UNION ALL ".join(f"SELECT timestamp, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM provenance_log" for m, x in _FACTS.items()) + ")"


def _facts(spark, sf_dir):
    """All seven histograms' values, from one scan."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(x).cast("double").alias("value")) for m, x in _FACTS.items()])
    return view(spark, sf_dir, "provenance_log").select("timestamp", F.inline(each))


@query(_FACTS_SQL + " SELECT metric, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in telemetry.BOUNDS) + ", count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high FROM facts GROUP BY metric")
def metrics_histograms(spark, sf_dir):
    return telemetry.histogram(_facts(spark, sf_dir), "value", "metric")


_G = "(1.01::DOUBLE / 0.99::DOUBLE)"
_POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    _FACTS_SQL
    + f""", buckets AS (SELECT metric, CASE WHEN value > 0 THEN CAST(ceil(ln(value) / ln({_G})) AS INT) END AS bucket, count(*) AS n FROM facts GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY metric) AS all_n FROM buckets)
SELECT metric, CAST(sum(n) AS BIGINT) AS n, {", ".join(f"round(min(CASE WHEN upto > floor({q} * (all_n - 1)) THEN CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({_G}, bucket) / ({_G} + 1) END END), 6) AS {name}" for name, q in _POINTS.items())} FROM upto GROUP BY metric"""
)
def metrics_quantiles(spark, sf_dir):
    """Sketches of five-minute windows, merged over all of them."""
    windows = telemetry.windowed_sketch(_facts(spark, sf_dir), "value", "metric")
    out = telemetry.quantiles(telemetry.merged(windows, "metric"), _POINTS, "metric")
    return out.select("metric", "n", *[F.round(name, 6).alias(name) for name in _POINTS])


# documents of every stage, from the log's rows
_OUTCOMES = {
    "policy_step": "CASE event_id % 9 WHEN 0 THEN 'domain' WHEN 1 THEN 'robots' WHEN 2 THEN 'rate' ELSE 'pass' END", "level": "CASE WHEN event_id % 10 < 3 THEN CAST(event_id % 10 AS INT) END", "scraped": "event_id % 9 > 2 AND event_id % 10 < 3 AND event_id % 4 <> 0",
    "pii_blocked": "event_id % 9 > 2 AND event_id % 10 < 3 AND event_id % 4 <> 0 AND event_id % 7 = 0", "entity_count": "CAST(event_id % 6 AS INT)", "chunk_count": "CAST(event_id % 5 AS INT)", "over_count": "CAST(event_id % 2 AS INT)", "inj_blocked": "event_id % 11 = 0",
}
_TRIED, _SCREENED = "policy_step = 'pass'", "scraped AND NOT pii_blocked"


def _total(counter: str, what: str, level: str = "''") -> str:
    return f"SELECT '{counter}' AS counter, {level} AS level, CAST(coalesce({what}, 0) AS BIGINT) AS total FROM outcomes"


@query(
    ctes("provenance_log")
    + ", outcomes AS (SELECT request_id, " + ", ".join(f"{x} AS {c}" for c, x in _OUTCOMES.items()) + " FROM provenance_log) "
    + " UNION ALL ".join([
        _total("search.requests", "count(DISTINCT request_id)"), *[_total("scrape.attempts", f"count(*) FILTER ({_TRIED} AND level = {k})", f"'{name}'") for k, name in enumerate(("readability", "cdp", "cdp_stealth"))],
        _total("scrape.attempts", f"count(*) FILTER ({_TRIED} AND level IS NULL)", "'unknown'"), _total("scrape.errors", f"count(*) FILTER ({_TRIED} AND NOT scraped)"), _total("pii.entities", f"sum(entity_count) FILTER ({_SCREENED})"),
        _total("pii.blocked", "count(*) FILTER (pii_blocked)"), _total("injection.chunks", f"sum(chunk_count) FILTER ({_SCREENED})"), _total("injection.flagged", f"sum(over_count) FILTER ({_SCREENED})"),
        _total("injection.blocked", f"count(*) FILTER ({_SCREENED} AND inj_blocked)"), _total("rerank.requests", f"count(DISTINCT request_id) FILTER ({_SCREENED} AND NOT inj_blocked)"), _total("pipeline.requests", "count(DISTINCT request_id)"),
    ])
)
def metrics_pipeline(spark, sf_dir):
    """The ten counters over documents of all stages."""
    rows = view(spark, sf_dir, "provenance_log").selectExpr("request_id", *[f"{x} AS {c}" for c, x in _OUTCOMES.items()])
    return telemetry.pipeline_counters(rows, rows.select("request_id").distinct())


ALERTS = (
    alerts.Rule("error_rate", "share", "errors", 0.05, 5, 10), alerts.Rule("pii_unchecked", "rate", "unchecked", 0.0, 5, 5), alerts.Rule("reranker_down", "gauge", "available", 0.0, 1, 1), alerts.Rule("l2_surge", "rate", "l2", 0.004, 10, 7),
)
_ALERT_FACTS = "1 AS total, CAST(pii_action = 'blocked' AS INT) AS errors, CAST(event_id % 9 = 0 AS INT) AS unchecked, CAST(event_id % 3 > 0 AS INT) AS available, CAST(scraper_level = 2 AS INT) AS l2"


def _rule_sql(r: alerts.Rule) -> str:
    frame = f"OVER (ORDER BY minute ROWS BETWEEN {r.minutes - 1} PRECEDING AND CURRENT ROW)"
    value = {"share": f"CASE WHEN sum({r.total}) {frame} > 0 THEN sum({r.fact}) {frame} / sum({r.total}) {frame} END", "rate": f"coalesce(sum({r.fact}) {frame}, 0) / {60 * r.minutes}.0", "gauge": f"max({r.fact}) {frame}"}[r.kind]
    return f"SELECT '{r.name}' AS rule, {r.hold} AS hold, minute, coalesce({value} {'<=' if r.kind == 'gauge' else '>'} {r.threshold}, FALSE) AS active FROM grid"


@query(
    ctes("provenance_log")
    + f""", facts AS (SELECT CAST(floor(epoch_us(timestamp) / 60000000) AS BIGINT) AS minute, {_ALERT_FACTS} FROM provenance_log),
per AS (SELECT minute, sum(total)::DOUBLE AS total, sum(errors)::DOUBLE AS errors, sum(unchecked)::DOUBLE AS unchecked, max(available) AS available, sum(l2)::DOUBLE AS l2 FROM facts GROUP BY minute),
grid AS (SELECT * FROM (SELECT unnest(range(min(minute), max(minute) + 1)) AS minute FROM per) LEFT JOIN per USING (minute)),
ticks AS ({" UNION ALL ".join(_rule_sql(r) for r in ALERTS)}),
runs AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY rule ORDER BY minute) AS run, max(minute) OVER () AS stop FROM ticks),
held AS (SELECT rule, hold, run, min(minute) AS since, max(minute) AS last, any_value(stop) AS stop FROM runs WHERE active GROUP BY rule, hold, run),
steps AS (SELECT rule, 'pending' AS state, since AS minute FROM held UNION ALL SELECT rule, 'firing', since + hold FROM held WHERE last - since >= hold
  UNION ALL SELECT rule, CASE WHEN last - since >= hold THEN 'resolved' ELSE 'inactive' END, last + 1 FROM held WHERE last < stop)
SELECT rule, state, make_timestamp(minute * 60000000) AS at_minute FROM steps"""
)
def alert_states(spark, sf_dir):
    """Four rules over every minute: when each is pending, firing, resolved or inactive."""
    facts = view(spark, sf_dir, "provenance_log").selectExpr("timestamp", *[x.strip() for x in _ALERT_FACTS.split(", ")])
    out = alerts.transitions(alerts.ticks(facts, ALERTS), ALERTS)
    return out.select("rule", "state", F.col("at").cast("timestamp_ntz").alias("at_minute"))


# a request's stages one after the other, with a page and a record for each of its log's rows; records may overlap
_INTERVALS = r"""docs AS (SELECT request_id AS trace_id, event_id, 100 + (event_id * 37) % 500 AS a, 100 + (event_id * 37) % 500 + total_duration_ms AS b FROM provenance_log),
req AS (SELECT trace_id, max(b) AS last, count(*) AS n FROM docs GROUP BY trace_id),
intervals AS (
  SELECT trace_id, 'pipeline' AS name, 0 AS level, 0 AS started, last + 7 * n + 80 AS ended FROM req
  UNION ALL SELECT trace_id, 'search', 1, 2, 60 FROM req
  UNION ALL SELECT trace_id, 'policy', 1, 60, 60 + n % 40 FROM req
  UNION ALL SELECT trace_id, 'scrape', 1, 100, last FROM req
  UNION ALL SELECT trace_id, 'pii', 1, last, last + 3 * n FROM req
  UNION ALL SELECT trace_id, 'injection', 1, last + 2 * n, last + 5 * n FROM req
  UNION ALL SELECT trace_id, 'rerank', 1, last + 5 * n + 1, last + 5 * n + 50 FROM req
  UNION ALL SELECT trace_id, 'format', 1, last + 5 * n + 50, last + 7 * n + 80 FROM req
  UNION ALL SELECT trace_id, 'scrape.page', 2, a, b FROM docs
  UNION ALL SELECT d.trace_id, 'provenance', 2, last + 5 * n + 51 + event_id % 20, last + 5 * n + 60 + event_id % 23 FROM docs d JOIN req r ON r.trace_id = d.trace_id)"""


@query(
    ctes("provenance_log").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {_INTERVALS},
clipped AS (SELECT trace_id, name, level, started, greatest(started, ended) AS ended FROM intervals),
ids AS (SELECT *, substr(sha256(concat_ws('|', trace_id, name, level, started, ended, row_number() OVER (PARTITION BY trace_id, name, level, started, ended))), 1, 16) AS span_id FROM clipped),
held AS (SELECT c.span_id, arg_max(p.span_id, struct_pack(l := p.level, d := p.started - p.ended, s := p.started, id := p.span_id)) AS parent_id FROM ids c JOIN ids p ON p.trace_id = c.trace_id AND p.level < c.level AND p.started <= c.started AND p.ended >= c.ended GROUP BY c.span_id),
tree AS (SELECT ids.*, parent_id FROM ids LEFT JOIN held USING (span_id)),
later AS (SELECT *, max(ended) OVER (PARTITION BY parent_id ORDER BY started, ended, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY parent_id ORDER BY ended DESC, started DESC, span_id) AS r FROM tree WHERE parent_id IS NOT NULL),
covered AS (SELECT parent_id, sum(greatest(0, ended - greatest(started, coalesce(before, started)))) AS covered FROM later GROUP BY parent_id),
fold AS (SELECT parent_id, span_id, r, started AS until, TRUE AS decides FROM later WHERE r = 1
  UNION ALL SELECT x.parent_id, x.span_id, x.r, CASE WHEN x.ended <= f.until THEN x.started ELSE f.until END, x.ended <= f.until FROM fold f JOIN later x ON x.parent_id = f.parent_id AND x.r = f.r + 1),
path AS (SELECT span_id FROM tree WHERE parent_id IS NULL UNION ALL SELECT f.span_id FROM path JOIN fold f ON f.parent_id = path.span_id AND f.decides),
spent AS (SELECT parent_id, sum(ended - started) AS spent FROM tree JOIN path USING (span_id) GROUP BY parent_id)
SELECT t.trace_id, t.span_id, t.parent_id, t.name, CAST(t.started AS BIGINT) AS started, CAST(t.ended AS BIGINT) AS ended, CAST(t.ended - t.started - coalesce(covered, 0) AS BIGINT) AS self_us, p.span_id IS NOT NULL AS on_path,
  CAST(CASE WHEN p.span_id IS NULL THEN 0 ELSE t.ended - t.started - coalesce(spent, 0) END AS BIGINT) AS path_us
FROM tree t LEFT JOIN covered c ON c.parent_id = t.span_id LEFT JOIN path p ON p.span_id = t.span_id LEFT JOIN spent s ON s.parent_id = t.span_id"""
)
def trace_spans(spark, sf_dir):
    """Trees of all requests: eight stages and spans for documents, with self times and the critical path."""
    rows = spark.sql("WITH " + _INTERVALS.replace("FROM provenance_log", "FROM {log}") + " SELECT * FROM intervals", log=view(spark, sf_dir, "provenance_log"))
    return spans.assembled(rows).drop("level")


# --- whole ---------------------------------------------------------------------------------------


FLAGSHIP = Config(policy=FUNNEL, pii=PII(mode="redact"), injection=Injection(enabled=True, mode="annotate"), rerank=Rerank(provider="lexical", endpoint="builtin", top_k=5))


def _flagship(spark, sf_dir):
    results = view(spark, sf_dir, "search_results")
    requests = results.groupBy("request_id").agg(F.lit("").alias("category"), F.lit("").alias("language"), F.lit(20).alias("max_results"), F.min_by("title", "position").alias("query"))
    return requests, results, view(spark, sf_dir, "robots"), view(spark, sf_dir, "l0"), view(spark, sf_dir, "rendered")


@query(
    ctes("search_results", "robots")
    + f""", trimmed AS (SELECT * FROM search_results WHERE position <= 10), keyed AS (SELECT *, {norm()} AS norm_url FROM trimmed),
firsts AS (SELECT request_id, norm_url, min(position) AS position FROM keyed GROUP BY request_id, norm_url),
ordered AS (SELECT f.request_id, CAST(row_number() OVER (PARTITION BY f.request_id ORDER BY f.position) AS INT) AS position, k.url FROM firsts f JOIN keyed k ON k.request_id = f.request_id AND k.position = f.position),
{_ROBOTS.replace("FROM search_results s", "FROM ordered s")},
marked AS (SELECT *, NOT ({host()} <> '' AND {matches(BLOCKED)}) AS domain_ok FROM robots_marked),
stepped AS (SELECT *, CASE WHEN NOT domain_ok THEN 'domain' WHEN NOT robots_allowed THEN 'robots'
  WHEN NOT ({host()} = '' OR row_number() OVER (PARTITION BY request_id, {host()}, domain_ok AND robots_allowed ORDER BY position) <= 2) THEN 'rate' ELSE 'pass' END AS policy_step FROM marked)
SELECT request_id, count(*) FILTER (policy_step = 'domain') AS domain_dropped, count(*) FILTER (policy_step = 'robots') AS robots_blocked, count(*) FILTER (policy_step = 'rate') AS rate_limited,
  count(*) FILTER (policy_step = 'pass') AS results_after, count(*) FILTER (policy_step = 'pass') = 0 AS all_filtered FROM stepped GROUP BY request_id"""
)
def web_search_counts(spark, sf_dir):
    """What the flagship says of its results before pages are read."""
    out = web_search(spark, sf_dir)
    return out.select("request_id", "domain_dropped", "robots_blocked", "rate_limited", "results_after", (F.col("status") == "all_policy_filtered").alias("all_filtered"))


@query()
def web_search(spark, sf_dir):
    """The flagship: all requests of the results through every stage, ranked by the built-in provider."""
    return engine.web_search(*_flagship(spark, sf_dir), FLAGSHIP, {"lexical": rank.lexical_provider})


@query()
def web_search_provenance(spark, sf_dir):
    """The flagship's provenance: a record for each document that it delivers."""
    return engine.provenance_of(engine.ranked_documents(*_flagship(spark, sf_dir), FLAGSHIP, {"lexical": rank.lexical_provider}), "2026-01-01 00:00:00", FLAGSHIP)
