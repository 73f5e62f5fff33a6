"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators (regular expressions) propose spans; boosted trees score each
candidate from its format and context; a calibrated threshold per kind selects. Spans of the
fixed base patterns are always selected; candidates that overlap one are dropped, and of
overlapping candidates the best stays.

The trees are trained on the driver, from candidates written by rule (``training_candidates``), not from the
corpus, and are compiled to CASE expressions, so that the corpus is
only ever touched by built-in functions. Nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Possessive forms match what the plain ones match, as what follows a run is never in it; a run is entered at its start
# (or where the last match ended), so that long runs cost linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no base span of the kind.
_GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Generators of candidates beyond the base patterns.
GENERATORS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20|\x20@\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,5}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])",
}
_GENERATOR_GUARD = {"email": r"(?:\[at\]|\(at\)|\{at\}|\x20at\x20|\x20@\x20)", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[._/][0-9]{4}[._/]", "phone": r"[0-9)][\x20./-]{1,2}[0-9]{2,4}[\x20./-][0-9]{2,4}"}
#: Characters of context on either side.
CONTEXT = 28
CUES = {
    "phone_cue": r"(?i)(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|appel|rufen)[^0-9]*$",
    "mail_cue": r"(?i)(?:mail|contact|write|reach|schreib|correo|courriel|adresse)[^@]*$",
    "card_cue": r"(?i)(?:card|visa|master|amex|credit|karte|tarjeta|carte|payment|pay)[^0-9]*$",
    "net_cue": r"(?i)(?:ip|host|server|addr|ipv6|ping|node)[^0-9]*$",
    "other_cue": r"(?i)(?:order|invoice|version|isbn|ref|date|token|hash|sha|id|no\.|nr|time|page|chapter|mac)[^A-Za-z0-9]*$",
}
FEATURES = ("kind", "length", "digits", "groups", "brackets", "dots", "luhn", "leading_zero", "word_at", "word_dot", "sentence_gap", "top_level", "hex_letters", "date_like", *CUES)


def _matches(text: Column, pattern: str, guard: str) -> Column:
    """Array of (s, e, m): all leftmost matches that do not overlap, in code points, end exclusive."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.length(pair["p"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.array_append(state["out"], F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m"))).alias("out"))

    # arrays_zip ends with the text after the last match, which has no match of its own
    pairs = F.filter(F.arrays_zip(parts.alias("p"), found.alias("m")), lambda z: z["m"].isNotNull())
    return F.when(text.rlike(guard), F.aggregate(pairs, start, step, lambda state: state["out"])).otherwise(empty)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """The digits of ``m`` pass the Luhn test."""
    d = F.reverse(digits_of(m))

    def add(total: Column, i: Column) -> Column:
        v = F.ascii(F.substring(d, i, 1)) - 48
        twice = F.when(i % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits_of(m))
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return n.between(12, 19) & luhn(m)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _is_valid(kind: str):
    return lambda c: _valid(kind, c["m"])


# Format and context features, once as SQL over the corpus and once in Python over the training candidates.
_PATTERNS = {"brackets": r"[(\[{]", "dots": r"\.", "word_at": r"(?:\[at\]|\(at\)|\{at\})", "word_dot": r"(?:\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)", "sentence_gap": r"\.\x20|\x20\.", "top_level": r"(?i)(?:com|org|net|edu|de|fr|es|uk|io|info)$", "hex_letters": r"[A-Fa-f]", "date_like": r"^(?:19|20)[0-9]{2}[./-][01][0-9][./-][0-3][0-9]"}


def _features(kind: str, c: Column, left: Column) -> Column:
    m = c["m"]
    n = F.length(digits_of(m))
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    values = {
        "kind": F.lit(float(KINDS.index(kind))), "length": F.length(m).cast("double"), "digits": n.cast("double"), "groups": F.size(F.split(m, "[^0-9A-Za-z]+")).cast("double"),
        "luhn": one((n >= 12) & luhn(m)), "leading_zero": one(F.substring(digits_of(m), 1, 1) == "0"),
        **{k: one(m.rlike(p)) for k, p in _PATTERNS.items()}, **{k: one(left.rlike(p)) for k, p in CUES.items()},
    }
    return F.struct(*[values[k].alias(k) for k in FEATURES])


def _features_py(kind: str, m: str, left: str) -> list[float]:
    import re

    digits = re.sub("[^0-9]", "", m)
    total = sum((v if k % 2 == 0 else 2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(int(x) for x in reversed(digits)))
    values = {
        "kind": KINDS.index(kind), "length": len(m), "digits": len(digits), "groups": len(re.split("[^0-9A-Za-z]+", m)),
        "luhn": len(digits) >= 12 and total % 10 == 0, "leading_zero": digits[:1] == "0",
        **{k: bool(re.search(p, m)) for k, p in _PATTERNS.items()}, **{k: bool(re.search(p, left)) for k, p in CUES.items()},
    }
    return [float(values[k]) for k in FEATURES]


def training_candidates(n: int = 4000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Candidates written by rule, with labels: true ones in the formats people use, and look-alikes."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[int(r.integers(len(x)))]
    number = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(pick(*"abcdefghilmnoprstu") for _ in range(int(r.integers(3, 9))))
    neutral = lambda: f"{word()} {word()} "
    rows, labels = [], []

    def put(kind, m, left, label):
        rows.append(_features_py(kind, m, left))
        labels.append(label)

    for _ in range(n // 8):
        end = pick("com", "org", "net", "de", "fr")
        bracketed, spelled = pick("[at]", "(at)", "{at}", " [at] ", " (at) "), pick("[dot]", "(dot)", " (dot) ", " [dot] ", " dot ")
        left = pick(neutral(), "mail me: ", "contact ", "write ", "")
        plain = pick(f"{word()}{bracketed}{word()}{pick('.', spelled)}{end}", f"{word()}.{word()}{pick(' at ', bracketed)}{word()}{spelled}{end}", f"{word()} @ {word()}.{end}")
        put("email", plain, left, 1)
        put("email", f"{word()} {pick('at', 'at', '@')} {word()}{pick('. ', ' . ')}{word()}{pick('', '. ' + word(), '. ' + end, end)}", left, 0)
        sep = pick(" ", "-", ".")
        phone = pick(f"({number(3)}) {number(3)}-{number(4)}", f"0{number(3)}{sep}{number(3)}{sep}{number(4)}", f"{number(3)}{sep}{number(3)}{sep}{number(4)}")
        put("phone", phone, pick("phone: ", "call me on ", "Tel. ", "fax ", "mobile "), 1)
        put("phone", pick(phone, f"20{number(2)}-0{pick(*'123456789')}-1{number(1)}", f"{number(3)}.{number(3)}.{number(3)}", f"{number(3)} {number(2)} {number(3)}"), pick(neutral(), "order no. ", "version ", "ref ", "date "), 0)
        base = number(15)
        check = next(d for d in "0123456789" if _features_py("card", base + d, "")[FEATURES.index("luhn")])
        other = next(d for d in "0123456789" if d != check)
        grouped = lambda x, s: s.join(x[k : k + 4] for k in range(0, 16, 4))
        put("card", grouped(base + check, pick(".", "_", "/")), pick("card ", "visa: ", "pay with "), 1)
        put("card", grouped(base + pick(check, other, other), pick(".", "_", "/")), pick(neutral(), "order ", "id "), 0)
        six = ":".join("".join(pick(*"0123456789abcdef") for _ in range(4)) for _ in range(8))
        put("ip", six, pick("ip ", "host ", "server: ", neutral()), 1)
        put("ip", pick(f"{number(2)}:{number(2)}:{number(2)}", ":".join("".join(pick(*"0123456789abcdef") for _ in range(2)) for _ in range(6))), pick(neutral(), "time ", "mac "), 0)
    return np.array(rows), np.array(labels, float)


def _tree(x, g, h, depth):
    """A regression tree on gradients: a number, or (feature, threshold, left, right)."""
    leaf = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 8:
        return leaf
    best = (1e-6, None)
    base = g.sum() ** 2 / (h.sum() + 1)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        cuts = (values[1:] + values[:-1]) / 2
        for t in cuts if len(cuts) <= 24 else np.quantile(cuts, np.linspace(0.02, 0.98, 24)):
            low = x[:, k] <= t
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - base
            if gain > best[0]:
                best = (gain, (k, float(t)))
    if best[1] is None:
        return leaf
    k, t = best[1]
    low = x[:, k] <= t
    return k, t, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _apply(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, t, low, high = tree
    return np.where(x[:, k] <= t, _apply(low, x), _apply(high, x))


@lru_cache(maxsize=4)
def fit_trees(rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> tuple[list, dict[str, float]]:
    """Boosted trees and, per kind, the least margin at which a held-out part reaches ``precision`` (at least even odds)."""
    x, y = training_candidates()
    fit = np.random.default_rng(1).random(len(x)) < 0.75
    trees, z = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x[fit], (y - p)[fit], (p * (1 - p))[fit], depth)
        trees.append(tree)
        z += rate * _apply(tree, x)
    cuts = {}
    for k, kind in enumerate(KINDS):
        own = ~fit & (x[:, 0] == k)
        order = np.argsort(-z[own])
        good = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        enough = np.flatnonzero(good >= precision)
        cuts[kind] = max(0.0, float(z[own][order][enough[-1]])) if len(enough) else float("inf")
    return [(rate, t) for t in trees], cuts


def _case(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    k, t, low, high = tree
    return F.when(f[FEATURES[k]] <= t, _case(low, f)).otherwise(_case(high, f))


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two more columns, base_spans and added_spans: arrays of (s, o, e, kind), by start, then kind as listed.

    Offsets count code points, the end is exclusive. Null text counts as empty. Other columns stay,
    whatever their names; only those of the two new names are replaced.
    """
    trees, cuts = fit_trees()
    span = lambda kind: lambda c: F.struct(c["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), c["e"].alias("e"), F.lit(kind).alias("kind"))
    t = F.col("pii_text")
    columns = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("pii_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("pii_text"))
    df = df.withColumns({f"pii_{k}": _matches(t, BASE[k], _GUARD[k]) for k in KINDS} | {f"pii_more_{k}": _matches(t, GENERATORS[k], _GENERATOR_GUARD[k]) for k in KINDS})
    base = F.concat(*[F.transform(F.filter(f"pii_{k}", _is_valid(k)), span(k)) for k in KINDS])
    df = df.withColumn("base_spans", F.array_sort(base))

    def scored(kind: str):
        def one(c: Column) -> Column:
            left = F.substring(t, F.greatest(c["s"] - CONTEXT, F.lit(0)) + 1, F.least(c["s"], F.lit(CONTEXT)))
            return F.struct(c["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), c["e"].alias("e"), F.lit(kind).alias("kind"), _features(kind, c, left).alias("f"))

        def margin(c: Column) -> Column:
            z = reduce(lambda a, b: a + b, [F.lit(rate) * _case(tree, c["f"]) for rate, tree in trees])
            return F.struct(c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e"), c["kind"].alias("kind"), (z - F.lit(cuts[kind])).alias("z"))

        clear = F.filter(f"pii_more_{kind}", lambda c: ~F.exists("base_spans", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        return F.filter(F.transform(F.transform(clear, one), margin), lambda c: c["z"] >= 0)

    df = df.withColumn("pii_scored", F.concat(*[scored(k) for k in KINDS]))
    beaten = lambda c: F.exists("pii_scored", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]) & ((b["z"] > c["z"]) | ((b["z"] == c["z"]) & ((b["s"] < c["s"]) | ((b["s"] == c["s"]) & (b["o"] < c["o"]))))))
    plain = F.transform(F.filter("pii_scored", lambda c: ~beaten(c)), lambda c: F.struct(c["s"].alias("s"), c["o"].alias("o"), c["e"].alias("e"), c["kind"].alias("kind")))
    df = df.withColumn("added_spans", F.array_sort(plain))
    return df.select("pii_row.*", "base_spans", "added_spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; null texts stay null. Overlapping spans are replaced as one, under the first one's kind."""
    found = find_spans(docs, text)
    spans = F.array_sort(F.concat("base_spans", "added_spans"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        piece = F.concat(F.substring(t, a["at"] + 1, F.greatest(c["s"] - a["at"], F.lit(0))), F.lit("["), F.upper(c["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], c["e"]).alias("at"), F.when(c["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], piece)).alias("out"))

    clean = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), clean)).drop("base_spans", "added_spans")
