"""What a model is asked to summarise: a story's accounts, each told once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .newsrooms import distinct_texts, longest
from .tables import written

#: Accounts in a prompt and characters of each.
MOST_ARTICLES, MOST_CHARS = 6, 1800


def assemble(articles: DataFrame, topics: list[str] | None = None, cluster: str = "cluster_id", distinct: bool = True) -> DataFrame:
    """(cluster, articles, picked, prompt) of articles (id, cluster, source_id, name, bias, title, lead, body, published_at).

    L4: one article for each outlet, of the longest body; copies left out
    (title and body, or lead, under half alike to all before; not with distinct
    off); the six longest, ties by time and id, each as a tagged piece of 1,800
    characters. Sides are named where any of the six has one. topics are
    recent ones, offered as a hint. Null titles, leads and bodies are empty.
    """
    text = F.coalesce("body", "lead", F.lit(""))
    one = longest(articles.where(F.col(cluster).isNotNull()), cluster)
    one = written(one.select(F.col(cluster).alias("cluster"), "id", "size", "name", "bias", "published_at", F.coalesce("title", F.lit("")).alias("title"), text.alias("account")))
    if distinct:
        kept = distinct_texts(one.select("cluster", "id", "size", F.concat_ws(" ", "title", "account").alias("text")))
        chosen = one.join(kept, "id", "left_semi")
    else:
        chosen = one
    order = Window.partitionBy("cluster").orderBy(F.desc("size"), F.col("published_at").asc_nulls_last(), "id")
    six = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_ARTICLES)
    framed = F.array_max(F.transform("six", lambda x: x["bias"].isNotNull()))
    lean = lambda x: F.when(framed & x["bias"].isNotNull(), F.concat(F.lit(' lean="'), x["bias"], F.lit('"'))).otherwise("")
    piece = lambda x: F.concat(F.lit('<article n="'), x["n"].cast("string"), F.lit('" source="'), F.coalesce(x["name"], F.lit("")), F.lit('"'), lean(x), F.lit(">\n<title>"), x["title"], F.lit("</title>\n"), x["account"], F.lit("\n</article>"))
    grouped = six.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("n", "name", "bias", "title", F.left("account", F.lit(MOST_CHARS)).alias("account")))).alias("six"))
    total = articles.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("articles"))
    hint = f"Recent topics: {'; '.join(topics)}\n\n" if topics else ""
    head = F.concat(F.lit(hint), F.col("articles").cast("string"), F.lit(" articles cover this one event. Here are "), F.size("six").cast("string"), F.lit(" of them.\n\n"))
    rows = grouped.join(total, "cluster")
    return rows.select(F.col("cluster").alias(cluster), "articles", F.size("six").alias("picked"), F.concat(head, F.array_join(F.transform("six", piece), "\n\n")).alias("prompt"))
