"""What may be fetched, what a page says, and summaries without a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.robots import verdicts
from ..sources.adapter import News
from .grouping import CYCLE, cycle
from .registry import query
from .texts import documents

AGENT = "newsbot"
#: Policies that hosts are given here by the length of their names.
POLICIES = [
    "User-agent: *\nDisallow: /es/\nAllow: /es/1\nCrawl-delay: 90",
    "# by name\nUser-agent: OtherBot\nUser-agent: NEWS\nDisallow: /*/*.html$\nCrawl-delay: 2.5\n\nUser-agent: *\nDisallow: /",
    "Disallow: /\nUser-agent: *\nDisallow:\nno rule\n",
    "User-agent: a\nDisallow: /\nUser-agent: *\nDisallow: /*?utm\nDisallow: /en\nAllow: /e*\nUser-agent: *\nDisallow: /",
    "",
]
POLICIES_SQL = str([p.split("\n") for p in POLICIES])
#: Parts of a page that aren't its article, and entities with what they stand for, the ampersand last.
NOISE = r"(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}>" for t in ("script", "style", "nav", "aside", "header", "footer", "form", "noscript")) + r"|<div class=.ad.>.*?</div>"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
LEAST_BODY, MOST_BODY = 240, 8000


@query(f"""WITH host AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
line AS (SELECT host, unnest(range(0, 20)) AS pos, {POLICIES_SQL}[length(host) % 5 + 1] AS lines FROM host WHERE host <> ''),
kv AS (SELECT host, pos, lower(trim(split_part(l, ':', 1))) AS key, trim(substr(l, strpos(l, ':') + 1)) AS val FROM (SELECT host, pos, trim(split_part(lines[pos + 1], '#', 1)) AS l FROM line WHERE pos < len(lines)) WHERE strpos(l, ':') > 0),
prev AS (SELECT *, key = 'user-agent' AND NOT coalesce(lag(key = 'user-agent') OVER (PARTITION BY host ORDER BY pos), false) AS begins FROM kv),
grp AS (SELECT *, sum(begins::INT) OVER (PARTITION BY host ORDER BY pos) AS g FROM prev),
chosen AS (SELECT host, coalesce(min(g) FILTER (key = 'user-agent' AND val <> '*' AND contains('{AGENT}', lower(val))), min(g) FILTER (key = 'user-agent' AND val = '*')) AS g FROM grp GROUP BY host),
rule AS (SELECT grp.* FROM grp JOIN chosen USING (host, g)),
delay AS (SELECT host, arg_max(least(try_cast(val AS DOUBLE), 30) * 1000, pos) AS delay_ms FROM rule WHERE key = 'crawl-delay' AND try_cast(val AS DOUBLE) > 0 GROUP BY host),
pat AS (SELECT host, length(val) AS len, key = 'allow' AS allowed, '^' || replace(regexp_replace(rtrim_one, '([.+?^$' || chr(123) || chr(125) || '()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN val LIKE '%$' THEN '$' ELSE '' END AS p
 FROM (SELECT *, regexp_replace(val, '\\$$', '') AS rtrim_one FROM rule WHERE key IN ('allow', 'disallow') AND val <> '')),
page AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1), '^([?]|$)', '/\\1') AS path FROM pages)
SELECT page_id, page.host <> '' AND coalesce((SELECT arg_max(allowed, (len, allowed)) FROM pat WHERE pat.host = page.host AND regexp_matches(page.path, pat.p)), true) AS allowed, CAST(coalesce(delay_ms, 0) AS BIGINT) AS delay_ms
FROM page LEFT JOIN delay ON page.host = delay.host""", False)
def robots_verdict(spark, sf_dir):
    """Whether a page may be fetched, and the pause its host asks for.

    The first group that names us counts, else the first for all; of its rules that match a path the longest
    decides, allowing ones first among equals. What isn't an http address is refused. Lines are grouped inside one host's policy.
    """
    pages = News(spark, sf_dir).table("pages").select("page_id", "url")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    text = F.element_at(F.array(*map(F.lit, POLICIES)), F.length("host") % 5 + 1)
    policies = pages.select(host.alias("host")).where("host <> ''").distinct().select("host", F.lit(200).alias("status"), text.alias("text"))
    return verdicts(pages, policies, AGENT)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain_sql(expr: str) -> str:
    for entity, char in ENTITIES.items():
        expr = f"replace({expr}, {_quoted(entity)}, {_quoted(char)})"
    return expr


@query(rf"""WITH c AS (SELECT page_id, html, regexp_replace(coalesce(html, ''), {_quoted(NOISE)}, ' ', 'g') AS clean FROM pages),
a AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CASE WHEN regexp_matches(clean, '(?is)<article\b.*</article>') THEN regexp_extract(clean, '(?is)<article\b[^>]*>(.*)</article>', 1) ELSE regexp_replace(clean, '(?is)^.*<body\b[^>]*>', '') END AS inner_html FROM c),
t AS (SELECT page_id, title, trim(regexp_replace({_plain_sql("regexp_replace(inner_html, '<[^>]*>', ' ', 'g')")}, '[ \t\n\r\f\v]+', ' ', 'g')) AS flat FROM a)
SELECT page_id, trim({_plain_sql("title")}) AS title, CASE WHEN length(flat) > {LEAST_BODY} THEN left(flat, {MOST_BODY}) END AS body FROM t""", False)
def extract_body(spark, sf_dir):
    """A page's title and the text of its article, else of its whole body, without scripts, navigation, notices and advertisements; null up to 240 characters, cut at 8,000."""

    def plain(c: Column) -> Column:
        for entity, char in ENTITIES.items():
            c = F.replace(c, F.lit(entity), F.lit(char))
        return c

    html = F.coalesce("html", F.lit(""))
    clean = News(spark, sf_dir).table("pages").select("page_id", F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_replace(html, NOISE, " ").alias("clean"))
    article, body = F.regexp_extract("clean", r"(?is)<article\b[^>]*>(.*)</article>", 1), F.regexp_replace("clean", r"(?is)^.*<body\b[^>]*>", "")
    inner = F.when(F.col("clean").rlike(r"(?is)<article\b.*</article>"), article).otherwise(body)
    flat = F.trim(F.regexp_replace(plain(F.regexp_replace(inner, "<[^>]*>", " ")), "[ \t\n\r\f\x0b]+", " "))
    return clean.select("page_id", F.trim(plain(F.col("title"))).alias("title"), F.when(F.length(flat) > LEAST_BODY, F.left(flat, F.lit(MOST_BODY))).alias("body"))


@query(rf"""WITH g AS (SELECT doc_id // {CYCLE} AS cycle, source, count(*) AS n, arg_max(coalesce(text, ''), (length(coalesce(text, '')), -doc_id)) AS body FROM documents GROUP BY 1, 2),
s AS (SELECT cycle, source, n, split_part(body, chr(10), 1) AS title, string_split(regexp_replace(trim(regexp_replace(body, '[ \t\n\r\f\v]+', ' ', 'g')), '([.!?]) +([A-Z"''“])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS sentences FROM g),
t AS (SELECT *, trim(left(array_to_string(sentences[1:5], ' '), 620)) AS best FROM s),
c AS (SELECT *, CASE WHEN regexp_matches(best, '[.!?]["\x29\x{{2019}}\x{{201d}}]?$') THEN best ELSE regexp_extract(best, '(?s)^(.*[.!?])', 1) END AS crux FROM t)
SELECT cycle, source, left(regexp_replace(title, '\s*[|–-]\s*[^|–-]{{0,24}}$', ''), 90) AS headline, crux, CAST(least(5, 1 + round(log2(n + 1))) AS BIGINT) AS importance FROM c WHERE crux <> ''""", False)
def extractive_summary(spark, sf_dir):
    """Of each outlet's articles in a cycle the longest, its first five sentences in 620 characters up to the last whole one, its title without the outlet's name; none without a whole sentence. A partial aggregate finds the longest."""
    text = F.coalesce("text", F.lit(""))
    longest = F.max_by(text, F.struct(F.length(text), -F.col("doc_id"))).alias("body")
    groups = documents(spark, sf_dir).groupBy(cycle("doc_id").alias("cycle"), "source").agg(F.count("*").alias("n"), longest)
    flat = F.trim(F.regexp_replace("body", "[ \t\n\r\f\x0b]+", " "))
    sentences = F.slice(F.split(flat, "(?<=[.!?]) +(?=[A-Z\"'“])"), 1, 5)
    rows = groups.select("cycle", "source", "n", F.split_part("body", F.lit("\n"), F.lit(1)).alias("title"), F.trim(F.left(F.array_join(sentences, " "), F.lit(620))).alias("best"))
    crux = F.when(F.col("best").rlike("[.!?][\")’”]?$"), F.col("best")).otherwise(F.regexp_extract("best", "(?s)^(.*[.!?])", 1))
    headline = F.left(F.regexp_replace("title", r"\s*[|–-]\s*[^|–-]{0,24}$", ""), F.lit(90))
    importance = F.least(F.lit(5.0), 1 + F.round(F.log2(F.col("n") + 1))).cast("long")
    return rows.select("cycle", "source", headline.alias("headline"), crux.alias("crux"), importance.alias("importance")).where("crux <> ''")
