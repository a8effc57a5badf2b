"""The corpus fingerprint against a plain hash over the sorted ids."""

import hashlib

from corpuscle.operators import chunks as C
from corpuscle.operators import index as I


def test_fingerprint_is_the_hash_of_the_sorted_ids(spark):
    ids = [f"chunk-{i * 7919 % 3000:05d}" for i in range(2500)] + ["chunk-00007", "é", "Z", "a", "a"]
    df = spark.createDataFrame([(x,) for x in ids], "chunk_id string")
    want = (len(ids), len(set(ids)), hashlib.sha256("|".join(sorted(ids)).encode()).hexdigest()[:32])
    assert [tuple(C.fingerprint(df.repartition(n)).first()) for n in (1, 7)] == [want, want]
    changed = df.replace("chunk-00000", "chunk-99999")
    assert C.fingerprint(changed).first()["ids_hash"] != want[2] and C.fingerprint(changed).first()["count"] == want[0]
    assert I.index_is_fresh(df, C.fingerprint(df.repartition(3))) and not I.index_is_fresh(changed, C.fingerprint(df))
    assert tuple(C.fingerprint(df.limit(0)).first()) == (0, 0, hashlib.sha256(b"").hexdigest()[:32])
    assert tuple(C.fingerprint(spark.createDataFrame([(None,), ("x",)], "chunk_id string")).first()) == (2, 1, hashlib.sha256(b"x").hexdigest()[:32])
