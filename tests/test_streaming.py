"""Streaming prediction over arriving page files equals the batch plan."""

import os
import tempfile

from spanweave.config import TextParams
from spanweave.operators import scoring
from spanweave.sources import pages as src
from spanweave.streaming.page_stream import start_prediction_stream, tag_pages


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="spanweave-stream-", dir="/tmp")
    os.makedirs(f"{root}/in/City")
    texts = {1: "東京 - Wikipedia Dump\n東京都の人口\n", 2: "大阪 - Wikipedia Dump\n大阪府の人口は多い\n"}
    for k, v in texts.items():
        with open(f"{root}/in/City/{k}.txt", "w", encoding="utf-8") as f:
            f.write(v)
    model = spark.createDataFrame(
        [("City", "pop", "の", "人", "B"), ("City", "pop", "人", "口", "I")],
        "category string, attribute string, prev_ch string, ch string, bio string")
    p = TextParams(header_last=0)
    scorer = lambda kept: scoring.score_with_counts(kept, model)
    q = start_prediction_stream(spark, f"{root}/in", f"{root}/out", p, scorer,
                                checkpoint=f"{root}/ckpt", trigger_once=True)
    q.awaitTermination(120)
    got = sorted((r.page_id, r.text_offset.text) for r in src.read_predictions(spark, f"{root}/out").collect())
    batch = tag_pages(src.read_pages(spark, f"{root}/in"), p, scorer)
    assert got == sorted((r.page_id, r.text_offset.text) for r in batch.collect())
    assert got == [(1, "人口"), (2, "人口")]
