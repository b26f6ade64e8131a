"""Validation facts as a stream: joined with solutions, emitted as soon as a solution is complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FACT = "id string, n_vars int, var string, instance string, shape string, valid boolean, reason string"
DONE = "id string, var string, instance string, shape string, valid boolean, reason string"

def read_facts(spark: SparkSession, path: str, schema: str = FACT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def complete_early(facts: DataFrame, targets: dict[str, list[str]], keep_ms: int | None = None) -> DataFrame:
    """Emits a solution's facts once each of its n_vars variables has an acceptable one.

    State per solution: the facts so far, and whether it was emitted; later facts of an emitted
    solution are dropped. With keep_ms, for streams that go on, a state goes when no fact came for so
    long, and a solution that is not complete by then is not emitted; a stream that is drained once
    needs none.
    """
    wanted = {k.lower(): set(v) for k, v in targets.items()}
    names = [x.split()[0] for x in DONE.split(", ")]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, held = state.get if state.exists else (False, [])
        held = [tuple(x) for x in held]
        for p in pdfs:
            if done:
                continue
            for r in p.itertuples(index=False):
                shape = r.shape if isinstance(r.shape, str) else None
                ok = shape is None or r.var.lower() not in wanted or shape in wanted[r.var.lower()]
                if ok and any(h[0] == r.var and h[5] for h in held):
                    continue
                held.append((r.var, r.instance, shape, None if shape is None else bool(r.valid), r.reason if shape is not None else None, ok))
                if len({h[0] for h in held if h[5]}) == r.n_vars:
                    done = True
                    yield pd.DataFrame([(key[0], *h[:5]) for h in held], columns=names)
                    held = []
                    break
        state.update((done, held))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)

    kept = "done boolean, held array<struct<var:string,instance:string,shape:string,valid:boolean,reason:string,ok:boolean>>"
    return facts.groupBy("id").applyInPandasWithState(step, DONE, kept, "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def annotate_stream(stream: DataFrame, key: str, validation: DataFrame) -> DataFrame:
    """A stream of rows with each row's validation facts, by a join with the static facts."""
    v = validation.select(F.col("instance").alias(key), "shape", "valid", "reason")
    return stream.join(v, key, "left")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that there is, into Parquet at path, and read it."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
