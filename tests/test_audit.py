"""Audit chains, in batches and as a stream, against chains made one event after another."""

import hashlib
import hmac
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from codelode.operators import audit
from codelode.streaming import audit as stream

KEY, START = b"a key", datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, rows):
    """rows: tenant, minute, request."""
    made = [(t, START + timedelta(minutes=m, microseconds=7), "u", "read", "doc", "1", "ALLOWED", q, "k1") for t, m, q in rows]
    return spark.createDataFrame(made, audit.EVENT)


def plainly(rows):
    """Hashes of each tenant's events by the definition."""
    out, last = {}, {}
    for t, m, q in sorted(rows, key=lambda r: (r[1], r[2])):
        n, previous = last.get(t, (0, "0" * 64))
        said = [n + 1, t, int(START.timestamp()) + 60 * m, 7000, "u", "read", "doc", "1", "ALLOWED", q, "k1", previous]
        last[t] = n + 1, hmac.new(KEY, "\0".join(map(str, said)).encode(), hashlib.sha256).hexdigest()
        out[t, n + 1] = previous, last[t][1]
    return out


def held(chain):
    return {(r["tenant_id"], r["sequence"]): (r["previous_hash"], r["hash"]) for r in chain.collect()}


def problems(chain, **known):
    return sorted(tuple(r) for r in audit.verify(KEY, chain, **known).collect())


ROWS = [("a", 3, "q3"), ("a", 1, "q1"), ("b", 1, "q1"), ("a", 2, "q2"), ("a", 2, "q1"), ("c", 9, "q")]


def test_chains_are_those_of_the_definition(spark):
    chain = audit.append(KEY, events(spark, ROWS))
    assert held(chain) == plainly(ROWS) and problems(chain) == []
    assert audit.append(KEY, events(spark, [])).count() == 0 and problems(chain.limit(0)) == []
    with pytest.raises(Exception, match="no null fields"):
        audit.append(KEY, events(spark, ROWS).withColumn("action", F.lit(None).cast("string"))).collect()


def test_a_chain_goes_on_from_its_head(spark):
    first, more = ROWS[1:3], [("a", 20, "x"), ("b", 20, "x"), ("d", 20, "x")]
    chain = audit.append(KEY, events(spark, first))
    rest = audit.append(KEY, events(spark, more), audit.heads(chain))
    assert held(chain.union(rest)) == plainly(first + more)
    with pytest.raises(Exception, match="at most 1 events|at most 0 events"):
        audit.append(KEY, events(spark, more), audit.heads(chain), most=1).collect()


def test_what_is_wrong_with_a_chain(spark):
    chain = audit.append(KEY, events(spark, ROWS)).cache()
    at = (F.col("tenant_id") == "a") & (F.col("sequence") == 2)
    ends = audit.heads(chain)
    assert problems(chain.withColumn("action", F.when(at, "write").otherwise(F.col("action")))) == [("a", 2, "AUTHENTICATION")]
    assert problems(chain.filter(~at)) == [("a", 3, "SEQUENCE")]
    assert problems(chain.union(chain.filter(at))) == [("a", 2, "SEQUENCE")] * 2
    assert problems(chain.withColumn("hash", F.when(at, F.lit("f" * 64)).otherwise(F.col("hash")))) == [("a", 2, "AUTHENTICATION"), ("a", 3, "CHAIN")]
    assert problems(chain.withColumn("previous_hash", F.when(at, None).otherwise(F.col("previous_hash")))) == [("a", 2, "AUTHENTICATION"), ("a", 2, "CHAIN")]
    assert problems(chain.filter("sequence < 4 AND tenant_id <> 'c'"), ends=ends) == [("a", 3, "END"), ("c", 1, "END")]
    assert len(audit.verify(b"another", chain).collect()) == len(ROWS)
    kept, gone = chain.filter("sequence > 2"), chain.filter("sequence <= 2")
    assert problems(kept, known=audit.anchors(gone), ends=ends.filter("tenant_id = 'a'")) == []
    assert problems(kept) == [("a", 3, "CHAIN")]


def test_a_stream_goes_on_after_a_restart_and_from_heads(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    old = audit.append(KEY, events(spark, [("a", 0, "old")])).cache()
    run = lambda: stream.extend(spark, KEY, at("in"), at("chain"), at("checkpoint"), audit.heads(old)).awaitTermination()
    late = [("a", 30, "x"), ("d", 31, "x"), ("d", 31, "x")]
    for rows in (ROWS, late):
        events(spark, rows).repartition(2).write.mode("append").parquet(at("in"))
        run()
        run()  # nothing new: nothing is added
    chain = spark.read.parquet(at("chain")).select(*old.columns).union(old)
    assert held(chain) == plainly([("a", 0, "old"), *ROWS, *late]) and chain.count() == 10 and problems(chain, ends=audit.heads(chain)) == []


def test_a_stream_stops_at_a_full_chain(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    events(spark, ROWS).write.parquet(at("in"))
    with pytest.raises(Exception, match="at most 3 events"):
        stream.extend(spark, KEY, at("in"), at("chain"), at("checkpoint"), most=3).awaitTermination()
    stream.extend(spark, KEY, at("in"), at("chain"), at("checkpoint")).awaitTermination()  # the batch is run again
    assert held(spark.read.parquet(at("chain"))) == plainly(ROWS)
