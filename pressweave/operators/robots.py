"""What hosts let a reader fetch, and how fast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: the longest pause that a host can ask for, in seconds.
LONGEST_PAUSE = 30.0


def verdicts(pages: DataFrame, policies: DataFrame, agent: str) -> DataFrame:
    """(page_id, allowed, delay_ms) of pages (page_id, url), for policies (host, status, text).

    H1, S12: the first group that names a part of agent counts, else the first
    for all; of its rules that match a path the longest decides, allowing ones
    first among equals; the last pause counts, 30 s at most. A host that
    answers 500 and above allows nothing; one without a policy, of any other
    status than 200 or that didn't answer (null) allows all. What is no http
    address is refused. A host's policy is read in one piece, its lines in order.
    """
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1), r"^([?]|$)", "/$1")
    asked = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), path.alias("path"))
    broken = policies.where("status >= 500").select("host", F.lit(True).alias("broken"))
    lines = policies.where("status BETWEEN 200 AND 299").select("host", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    line = F.trim(F.split_part("raw", F.lit("#"), F.lit(1)))
    pairs = lines.select("host", "pos", line.alias("line")).where(F.instr("line", ":") > 0)
    pairs = pairs.select("host", "pos", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("val"))
    order, names = Window.partitionBy("host").orderBy("pos"), F.col("key") == "user-agent"
    begins = names & ~F.coalesce(F.lag(names).over(order), F.lit(False))
    groups = pairs.withColumn("begins", begins.cast("int")).withColumn("g", F.sum("begins").over(order))
    named = names & (F.col("val") != "*") & F.lit(agent).contains(F.lower("val"))
    chosen = groups.groupBy("host").agg(F.coalesce(F.min(F.when(named, F.col("g"))), F.min(F.when(names & (F.col("val") == "*"), F.col("g")))).alias("g"))
    rules = groups.join(chosen, ["host", "g"])
    seconds = F.expr("try_cast(val AS DOUBLE)")
    delay = rules.where((F.col("key") == "crawl-delay") & (seconds > 0)).groupBy("host").agg(F.max_by(F.least(seconds, F.lit(LONGEST_PAUSE)) * 1000, "pos").alias("delay_ms"))
    # a question mark or a full stop in a rule stands for itself; only * and a last $ mean more
    escaped = F.replace(F.regexp_replace(F.regexp_replace("val", r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    pattern = F.concat(F.lit("^"), escaped, F.when(F.col("val").endswith("$"), "$").otherwise(""))
    patterns = rules.where("key IN ('allow', 'disallow') AND val <> ''").select("host", F.length("val").alias("len"), (F.col("key") == "allow").alias("rule_allows"), pattern.alias("pattern"))
    matched = asked.join(patterns, "host").where(F.rlike("path", F.col("pattern"))).groupBy("page_id").agg(F.max_by("rule_allows", F.struct("len", "rule_allows")).alias("found"))
    rows = asked.join(matched, "page_id", "left").join(delay, "host", "left").join(broken, "host", "left")
    allowed = (F.col("host") != "") & F.coalesce("found", F.lit(True)) & F.col("broken").isNull()
    return rows.select("page_id", allowed.alias("allowed"), F.coalesce("delay_ms", F.lit(0)).cast("long").alias("delay_ms"))


def social_image(html, url):
    """The picture that a page names for sharing: og:image, twitter:image, twitter:image:src or itemprop, the first that has an address; a relative one is under the page's host."""
    named = [r'property=["\']og:image["\']', r'name=["\']twitter:image["\']', r'name=["\']twitter:image:src["\']', r'itemprop=["\']image["\']']
    content = lambda mark: F.coalesce(F.nullif(F.trim(F.regexp_extract(html, rf'(?is)<meta\b[^>]*{mark}[^>]*\bcontent=["\']([^"\'>]*)["\']', 1)), F.lit("")), F.nullif(F.trim(F.regexp_extract(html, rf'(?is)<meta\b[^>]*\bcontent=["\']([^"\'>]*)["\'][^>]*{mark}', 1)), F.lit("")))
    origin, scheme = F.regexp_extract(url, "^(https?://[^/?#]+)", 1), F.regexp_extract(url, "^(https?:)", 1)
    folder = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^(https?://[^/]+/(?:.*/)?).*$", "$1")

    def absolute(raw):
        held = F.when(raw.rlike("(?i)^https?://"), raw).when(raw.startswith("//"), F.concat(scheme, raw)).when(raw.startswith("/"), F.concat(origin, raw))
        return held.when(~raw.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(origin, F.lit("/"))), raw))

    return F.coalesce(*[absolute(content(m)) for m in named])
