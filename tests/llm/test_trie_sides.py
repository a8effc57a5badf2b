"""No side of a join of the trie goes through the driver, however small its files look."""

import random

from corpuscle.llm import trie


def test_trie_broadcasts_nothing(spark, monkeypatch):
    plans, write = [], trie.written

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(trie, "written", lambda df, name, *a, **k: write(planned(df), name, *a, **k))
    rng = random.Random(4)
    rows = [(c, t, "user", f"turn {t if rng.random() < 0.9 else rng.random()}") for c in range(40) for t in range(rng.randrange(1, 40))]
    planned(trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(plans) >= 7 and sum("Join" in p for p in plans) >= 5
    assert not [p for p in plans if "Broadcast" in p]
