"""The manifest against a plain recursion, with groups of several blocks."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from verdictlake.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(enc, r)))

    def climb(nodes):
        """(root, paths): a path is a list of (left, right)."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
                paths[k].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            nodes, where = [sha("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)], [at // 16 for at in where]
        return nodes[0], paths

    groups = itertools.groupby(sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))), key=lambda r: r[1])
    groups = [list(g) for _, g in groups]
    climbed = [climb([leaf(r) for r in g]) for g in groups]
    root, tops = climb([c[0] for c in climbed])
    out = []
    for g, (subroot, paths), top in zip(groups, climbed, tops):
        for r, path in zip(g, paths):
            found = leaf(tampered(r))
            for left, right in path + top:
                found = sha(left + found + right)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in path + top)), found, found == root))
    return sorted(out, key=repr)


def test_manifest(spark):
    r = random.Random(4)
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "big": 4097 + 40, "é": 257, "zz": 256, "one": 1}
    rows = [(i * 7 % 5003, s, r.choice(["en", None, ""]), r.choice([None, i]), r.choice([None, "", "Text A", "é \U0001f600 B" * r.randint(1, 40)])) for s, n in sizes.items() for i in range(n)]
    rows += [(5, "a", "en", 1, "same")] * 3 + [(None, "a", None, None, None)] * 2 + [(None, None, "x", 2, "Z" * 200_000)]
    low = lambda x: x[:4] + ("".join(c.lower() if c.isascii() else c for c in x[4]),) if x[4] is not None and x[0] is not None and x[0] % 3 == 0 else x
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as node", "2 as at", "doc_id as id_").repartition(5)
    found = merkle.manifest(df, altered={"text": merkle.lower_ascii(F.col("text"))}, where=F.col("doc_id") % 3 == 0)
    assert sorted((tuple(x) for x in found.collect()), key=repr) == brute(rows, low)


def test_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 2, "ab")], schema)).collect()
    leaf = sha("1:11:s2:en1:22:ab")
    assert [tuple(x) for x in one] == [(1, leaf, leaf, leaf, sha(""), leaf, True)]
    many = [(i, f"s{i}", "en", 2, "ab") for i in range(300)]  # a source each
    assert sorted((tuple(x) for x in merkle.manifest(spark.createDataFrame(many, schema)).collect()), key=repr) == brute(many, lambda x: x)
