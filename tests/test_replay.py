"""All cycles at once against cycle after cycle."""

from __future__ import annotations

from datetime import timedelta

from pressweave.operators import cycles, replay

from .test_stories import START, article, clusters_of, stream_of_articles, table


def state(articles, clusters):
    return {r.id: r.cluster_id for r in articles.collect()}, {r.id: tuple(r) for r in clusters.select(*[c.split(" ")[0] for c in cycles.CLUSTER.split(", ")]).collect()}


def test_all_cycles_at_once_are_cycle_after_cycle(spark):
    """Cycles a day apart, each over four days, so that a story meets twins of the cycle before; the last one comes early."""
    hop, odd = timedelta(days=1), [(*article(90, None, None, None, None, 30)[:8], None, None), article(91, None, None, None, None, 31), article(92, "Harbour Strike Closes", "", None, "s9", 40, prominent=True)]
    held = cycles.written(table(spark, stream_of_articles(44, 5, 3) + odd))
    times = [START + hop * k for k in (1, 2, 3, 4, 5)] + [START + hop * 5.4]
    found, clusters, gone = replay.history(held, times, hop)
    at_once, lost = state(found, clusters), {r.id for r in gone.collect()}
    now, stored, missing = held, clusters_of(spark), set()
    for at in times:
        now, stored, left = cycles.advance(now, stored, at)
        missing |= {r.id for r in left.collect()}
    in_turn = state(now, stored)
    assert at_once == in_turn and lost == missing
    assert any(c[1] for c in in_turn[1].values()) and in_turn[0][90] is None
