"""What op5's sides list for the Hamming search grows with the items and is not sent to all tasks."""

import random
import re

from tessera.llm import decontaminate


def test_listed_values_are_not_broadcast(spark):
    draw = random.Random(5)
    items = [" ".join(f"w{draw.randrange(5000)}" for _ in range(draw.randrange(20, 40))) for _ in range(120)]
    docs = [(i, f"before {text} after" if i % 2 else f"{text.rsplit(' ', 1)[0]} other") for i, text in enumerate(items)] + [(None, items[0]), (500, None), (501, "")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert got.keys() == {(i, i) for i in range(120)} | {(None, 0)}
    assert all(got[i, i] == 1 for i in range(1, 120, 2)) and got[None, 0] == 1 and all(0.8 <= got[i, i] < 1 for i in range(0, 120, 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[size#\d+, block#\d+, value#\d+\]", plan)
    assert joins and "BroadcastHashJoin" not in joins  # 334,560 values of the items
