"""Which of many names occur in texts: one pass a text, however many names there are.

Names become an automaton (Aho-Corasick), which is built once per worker and reads each text once. Names are dealt into blocks of a stated number of
bytes, so that what is sent to the tasks is bounded: a longer list takes as many scans as it has blocks.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of names that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
_BUILT: dict[str, object] = {}


def _automaton(key: str, names: list[str]):
    """The automaton of a block; a worker keeps the one that it used last."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for n in names:
            a.add_word(n, n)
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def occurring(texts: DataFrame, names: DataFrame, id_col: str, text: str, name: str = "name", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, name, n): the names that are substrings of each text, with the number of places where they begin.

    Null and empty names and texts have none; names count once, however often they are listed; overlapping occurrences count. Rows that repeat an id are reported each.
    """
    spark = texts.sparkSession
    listed = names.select(F.col(name).alias("n_")).where("n_ <> ''").distinct()
    size = listed.agg(F.sum(F.octet_length("n_"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    id_type = texts.schema[id_col].dataType.simpleString()
    source = texts.select(F.col(id_col).alias("id_"), F.col(text).alias("t_")).where("t_ <> ''")
    parts = []
    for b in range(blocks):
        some = sorted(r.n_ for r in listed.where(F.pmod(F.xxhash64("n_"), F.lit(blocks)) == b).collect())
        sent = spark.sparkContext.broadcast(some)
        parts.append(source.mapInArrow(_found(sent, f"{spark.sparkContext.applicationId}-{id(sent)}-{b}-{len(some)}", name), f"id_ {id_type}, {name} string, n long"))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("id_", id_col)


def _found(sent, key: str, name: str):
    def run(batches):
        names = sent.value
        if not names:
            return
        automaton = _automaton(key, names)
        for batch in batches:
            rows, who, counts = [], [], []
            for k, t in enumerate(batch.column("t_").to_pylist()):
                here: dict[str, int] = {}
                for _, n in automaton.iter(t):
                    here[n] = here.get(n, 0) + 1
                for n in sorted(here):
                    rows.append(k)
                    who.append(n)
                    counts.append(here[n])
            yield pa.RecordBatch.from_arrays([batch.column("id_").take(pa.array(rows, pa.int64())), pa.array(who, pa.string()), pa.array(counts, pa.int64())], ["id_", name, "n"])

    return run
