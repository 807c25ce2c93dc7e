r"""Personal data by candidate gradient boosting: generators with high recall, boosted trees, calibrated thresholds.

Base spans are found by pattern and validator, leftmost and not overlapping for each kind:
  email, ip (parts at most 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). They always stay.
Further GENERATORS propose spans generously, overlapping base spans and each other: runs of digits with separators, anything
around an at sign, words of letters and digits, quoted or assigned values. Each candidate has a few features of small range, of
its format and its context. For each kind, trees of depth 2 are boosted on the logistic loss. Labels come from elsewhere than the features:
  numbers and addresses: whether a validated base span overlaps them;
  secrets: positive if a credential's name and an equals sign or colon stand before (no feature shows that), or if the value was
  made by a hash function: every MADE-th of the distinct ordinary words is replaced, wherever it stands, by a hexadecimal,
  base 64 or upper-case digest of itself. Negative are the other ordinary words (WORDS, proposed in training alone). What is
  neither is left out. So there are labels of both kinds in a corpus of any size, and none of a format that a pattern spells out.
Candidates of equal features and label are one cell with a count, so training reads a table of cells, bounded by the features'
ranges and not by the corpus. All candidates and words of all texts are counted, equal texts once. Each of FOLDS folds is
scored by trees of the others; on these scores each kind gets the least score whose precision is at least PRECISION, or none.
What reaches it is added under the kind, unless it overlaps a base span or what an earlier generator added.

All work is in SQL functions on whole texts, in the row. For training, texts are shuffled once, to find equal ones, and then
the counts of cells and words. Spans are compared by sorting and one
scan, so a text with many costs little more for each. Texts and values of any length are taken whole. Positions are code points,
ends are exclusive. Null text: empty, no spans. Null doc_id: as any row. Repeated rows: a row of results each. Ties: of candidates
that overlap, the earlier generator's stays, then the one that begins first. Empty table: no rows. Other columns are kept by
`redact`, whatever their names, and ignored by `detect`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE = ("email", "ip", "card", "phone")
PRECISION = 0.95
ROUNDS, RATE, LEAST_CELL, FOLDS = 30, 0.3, 5, 3
MADE = 4  # every fourth distinct ordinary word becomes a digest
_BLOCK = 256

# The contract's patterns. A match can only begin where a run of its first characters does, or where the last match ended;
# saying so, and never giving back what was taken, makes each scan linear. A card's run of digits is matched whole, so that
# the pattern can ask for 16 to 19 digits itself; shorter and longer runs are left aside as the validator would.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: name -> (kind of what it adds, pattern)
GENERATORS = {
    "number": ("number", r"(?<![0-9])[0-9(](?:[().-]?[0-9]|(?<![0-9]{12})\x20[0-9]){6,}+"),
    "at": ("address", r"(?<!\S)[^\s@]++@[^\s@]++"),
    "token": ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+=*+"),
    "quoted": ("secret", r"(?<=[=:]\x20?[\x22\x27]?)[^\x22\x27\s=:]{8,}+"),
}
KINDS = ("number", "address", "secret")
#: ordinary words, as negative examples
WORDS = r"(?<!\S)\p{L}{8,}+(?!\S)"
_NAMED = r"(?i)(?:token|secret|password|passwd|api.?key|credential)[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?$"


def _scan(values: Column, combine, first: int) -> Column:
    """For each place of an array of long, what combine makes of all before it. Blocks keep the arrays that are built up short."""
    none = "cast(array() AS array<{}>)"
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    state = lambda s, a: F.struct(s.alias("s"), a.alias("a"))

    def block(acc: Column, own: Column) -> Column:
        step = lambda t, x: state(combine(t["s"], x), F.concat(t["a"], F.array(t["s"])))
        return F.aggregate(own, state(acc["s"], F.expr(none.format("bigint"))), step, lambda t: state(t["s"], F.concat(acc["a"], F.array(t["a"]))))

    return F.aggregate(blocks, state(F.lit(first).cast("long"), F.expr(none.format("array<bigint>"))), block, lambda acc: F.flatten(acc["a"]))


def _prefix(steps: Column) -> Column:
    return _scan(steps, lambda s, x: s + x, 0)


def with_overlap(df: DataFrame, name: str, spans: str, marks: str) -> DataFrame:
    """Adds the array `name`: for each of spans (sorted by start, with start and end), whether it overlaps one of marks."""
    event = lambda x, own: F.struct(x["start"].cast("long").alias("start"), F.lit(own).alias("own"), x["end"].cast("long").alias("end"))
    far, some = 2**62, (F.size(spans) > 0) & (F.size(marks) > 0)
    df = df.withColumn("_events", F.when(some, F.array_sort(F.concat(F.transform(marks, lambda x: event(x, 0)), F.transform(spans, lambda x: event(x, 1))))))
    ends = F.transform("_events", lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0).cast("long"))
    starts = F.transform(F.reverse("_events"), lambda e: F.when(e["own"] == 0, e["start"]).otherwise(far).cast("long"))
    df = df.withColumns({"_before": F.when(some, _scan(ends, F.greatest, 0)), "_after": F.when(some, F.reverse(_scan(starts, F.least, far)))})
    each = F.filter(F.arrays_zip(F.col("_events").alias("e"), F.col("_before").alias("b"), F.col("_after").alias("a")), lambda z: z["e"]["own"] == 1)
    met = F.transform(each, lambda z: (z["b"] > z["e"]["start"]) | (z["a"] < z["e"]["end"]))
    return df.withColumn(name, F.when(some, met).otherwise(F.transform(spans, lambda x: F.lit(False)))).drop("_events", "_before", "_after")


def with_matches(df: DataFrame, name: str, pattern: str, where: Column) -> DataFrame:
    """Adds the array `name` of (start, end, value, before, after) of a pattern's matches in text, empty where not `where`."""
    df = df.withColumn("_m", F.when(where, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    some, n = F.size("_m") > 0, F.size("_m")
    df = df.withColumn("_g", F.when(some, F.split("text", pattern, -1)))
    df = df.withColumn("_s", F.zip_with(F.slice("_g", F.lit(1), n), "_m", lambda g, m: (F.length(g) + F.length(m)).cast("long")))
    df = df.withColumn("_p", F.when(some, _prefix(F.col("_s"))))
    z = F.arrays_zip(F.col("_m").alias("m"), F.col("_p").alias("p"), F.slice("_g", F.lit(1), n).alias("g"), F.slice("_g", F.lit(2), n).alias("h"))
    found = F.transform(z, lambda x: F.struct(
        (x["p"] + F.length(x["g"])).alias("start"), (x["p"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"), F.right(x["g"], F.lit(24)).alias("before"), F.left(x["h"], F.lit(1)).alias("after"),
    ))
    none = F.expr("cast(array() AS array<struct<start: bigint, end: bigint, value: string, before: string, after: string>>)")
    return df.withColumn(name, F.when(some, found).otherwise(none)).drop("_m", "_g", "_s", "_p")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    single, double = "0123456789", "0246813579"
    value = lambda x, i: F.when(i % 2 == 0, x).otherwise(F.translate(x, single, double)).cast("int")
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        d = _digits(v)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with text made non-null, and `base`: array of (kind, start, end), by kind as listed, then start."""
    df = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumns({"_digit": F.col("text").rlike("[0-9]"), "_at": F.contains("text", F.lit("@"))})
    digit = F.col("_digit")
    where = {"email": F.col("_at"), "ip": digit & F.contains("text", F.lit(".")), "card": digit, "phone": digit & F.contains("text", F.lit("+"))}
    found = []
    for kind in BASE:
        df = with_matches(df, f"_{kind}", PATTERNS[kind], where[kind])
        found.append(F.transform(F.filter(f"_{kind}", lambda x: _valid(kind, x["value"])), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return df.withColumn("base", F.concat(*found)).drop(*(f"_{k}" for k in BASE))


def _bucket(x: Column, edges: Iterable[int]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= e, 1).otherwise(0)
    return out


#: feature -> its value for a candidate; each has a small range
FEATURES = {
    "digits": lambda c: _bucket(F.length(_digits(c["value"])), (1, 7, 8, 10, 11, 12, 13, 16, 17, 20)),
    "letters": lambda c: _bucket(F.length(F.regexp_replace(c["value"], "[^A-Za-z]", "")), (1, 4, 8, 16)),
    "length": lambda c: _bucket(F.length(c["value"]), (8, 12, 16, 20, 32, 40, 64)),
    "hex": lambda c: c["value"].rlike("^[0-9a-f]+$").cast("int"),
    "parens": lambda c: c["value"].rlike(r"[()]").cast("int"),
    "dots": lambda c: _bucket(F.length(F.regexp_replace(c["value"], r"[^.]", "")), (1, 2, 3, 4)),
    "gaps": lambda c: _bucket(F.length(F.regexp_replace(c["value"], r"[^\x20-]", "")), (1, 2, 3)),
    "at_dot": lambda c: c["value"].rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9]").cast("int"),
    "plus_before": lambda c: c["before"].rlike(r"\+$").cast("int"),
    "quote_before": lambda c: c["before"].rlike(r"[\x22\x27]$").cast("int"),
    "quote_after": lambda c: c["after"].rlike(r"[\x22\x27]").cast("int"),
    "space_after": lambda c: (c["after"].rlike(r"^[\s.,;]") | (c["after"] == "")).cast("int"),
}


def candidates(df: DataFrame) -> DataFrame:
    """df of base_spans with an array for each generator: structs (kind, start, end, features..., near_base, named)."""
    digit, at = F.col("_digit"), F.col("_at")
    where = {"number": digit, "at": at, "token": digit, "quoted": F.col("text").rlike("[=:]")}

    def row(kind: str, c: Column, near: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *(f(c).alias(k) for k, f in FEATURES.items()), near.alias("near_base"), c["before"].rlike(_NAMED).alias("named"))

    of = lambda kind: lambda z: row(kind, z["c"], F.coalesce(z["n"], F.lit(False)))
    for name, (kind, pattern) in GENERATORS.items():
        df = with_matches(df, f"_{name}", pattern, where[name])
        df = with_overlap(df, "_near", f"_{name}", "base")
        df = df.withColumn(name, F.transform(F.arrays_zip(F.col(f"_{name}").alias("c"), F.col("_near").alias("n")), of(kind))).drop(f"_{name}", "_near")
    return df.drop("_digit", "_at")


def example(word: Column) -> Column:
    """The cell of an ordinary word as an example of secrets: a digest put in its place, label 1, or the word itself, label 0.

    White space or an end of the text is on both sides, which no feature tells apart."""
    h = F.xxhash64(word)
    digest = F.sha2(word, 512)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    value = F.when(F.pmod(h, F.lit(3)) == 0, digest).when(F.pmod(h, F.lit(3)) == 1, coded).otherwise(F.regexp_replace(F.upper(coded), "[^A-Z0-9]", "X"))
    value = F.left(value, (F.pmod(F.shiftright(h, 8), F.lit(72)) + 12).cast("int"))
    made = F.pmod(F.shiftright(h, 16), F.lit(MADE)) == 0
    c = F.struct(F.when(made, value).otherwise(word).alias("value"), F.lit("").alias("before"), F.lit("").alias("after"))
    # in an array, for the code of all features would be too long to be compiled
    return F.transform(F.array(c), lambda c: F.struct(F.lit(KINDS.index("secret")).alias("kind"), *(f(c).alias(k) for k, f in FEATURES.items()), made.cast("int").alias("label")))[0]


class Trees:
    """Boosted trees of depth 2 over cells: (features, positives, total) with small-integer features, kind first."""

    names = ("kind", *FEATURES)

    def __init__(self, cells: list[tuple[tuple[int, ...], float, float]]):
        self.trees: list[tuple] = []
        positive, total = sum(p for _, p, _ in cells), sum(t for *_, t in cells)
        self.bias = math.log((positive + 1) / (total - positive + 1))
        score = [self.bias] * len(cells)
        for _ in range(ROUNDS if cells else 0):
            grad, hess = [], []
            for (_, p, t), s in zip(cells, score, strict=True):
                q = 1 / (1 + math.exp(-s))
                grad.append(p - t * q)
                hess.append(t * q * (1 - q))
            tree = self._split(cells, grad, hess, range(len(cells)), 2)
            self.trees.append(tree)
            score = [s + self._value(tree, x) for (x, *_), s in zip(cells, score, strict=True)]

    def _split(self, cells, grad, hess, at, depth: int):
        g, h = sum(grad[i] for i in at), sum(hess[i] for i in at)
        leaf, best = RATE * g / (h + 1), (1e-6, None)
        for f in range(len(self.names)) if depth else ():
            sums: dict[int, list[float]] = {}
            for i in at:
                s = sums.setdefault(cells[i][0][f], [0, 0, 0])
                s[0], s[1], s[2] = s[0] + grad[i], s[1] + hess[i], s[2] + cells[i][2]
            left = [0.0, 0.0, 0.0]
            for v in sorted(sums)[:-1]:
                left = [a + b for a, b in zip(left, sums[v], strict=True)]
                right = sum(cells[i][2] for i in at) - left[2] if left[2] >= LEAST_CELL else 0
                if right >= LEAST_CELL:
                    gain = left[0] ** 2 / (left[1] + 1) + (g - left[0]) ** 2 / (h - left[1] + 1) - g**2 / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, v))
        if best[1] is None:
            return leaf
        f, v = best[1]
        sides = [[i for i in at if cells[i][0][f] <= v], [i for i in at if cells[i][0][f] > v]]
        return (f, v, *(self._split(cells, grad, hess, s, depth - 1) for s in sides))

    def _value(self, tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x) -> float:
        return self.bias + sum(self._value(t, x) for t in self.trees)

    def column(self, c: Column) -> Column:
        def of(tree) -> Column:
            if isinstance(tree, tuple):
                return F.when(c[self.names[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))
            return F.lit(float(tree))

        return sum((of(t) for t in self.trees), F.lit(self.bias))


def train(docs: DataFrame) -> tuple[list[Trees], dict[int, float]]:
    """(trees for each of KINDS, least score by place there) from all distinct texts; each kind has its own, so that none is outweighed."""
    texts = docs.select(F.col("text").cast("string")).dropDuplicates(["text"])
    found = candidates(base_spans(texts)).withColumn("fold", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(FOLDS)))
    named = F.filter(F.concat("token", "quoted"), lambda c: c["named"])
    no_word, no_cell = F.lit(None).cast("string"), F.lit(None).cast(f"struct<{', '.join(f'{k}: int' for k in (*Trees.names, 'label'))}>")
    label = lambda a, of: F.transform(a, lambda c: F.struct(no_word.alias("word"), F.struct(*(c[k].alias(k) for k in Trees.names), of(c).cast("int").alias("label")).alias("c")))
    words = F.transform(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), lambda w: F.struct(w.alias("word"), no_cell.alias("c")))
    labelled = F.concat(label(F.concat("number", "at"), lambda c: c["near_base"]), label(named, lambda c: F.lit(True)), words)
    # outer, for Spark would else filter on the array itself and make all of it twice
    each = found.select("fold", F.explode_outer(labelled).alias("e")).select("fold", "e.word", "e.c")
    # equal words have equal features, which are worked out once for each
    counted = each.groupBy("fold", "word", "c").agg(F.count("*").alias("n"))
    cells = counted.select("fold", "n", F.when(F.col("word").isNull(), F.col("c")).otherwise(example(F.col("word"))).alias("c"))
    sums: dict[tuple, list[float]] = {}
    for r in cells.groupBy("fold", "c").agg(F.sum("n").alias("n")).collect():  # bounded by the features' ranges
        if r.c is not None:
            *x, positive = r.c
            own = sums.setdefault((r.fold, tuple(map(int, x))), [0.0, 0.0])
            own[0], own[1] = own[0] + r.n * positive, own[1] + r.n
    rows = sorted((fold, x, p, t) for (fold, x), (p, t) in sums.items())
    scored = []
    kinds = [[r for r in rows if r[1][0] == kind] for kind in range(len(KINDS))]
    for own in kinds:
        for fold in range(FOLDS):
            trees = Trees([(x, p, t) for f, x, p, t in own if f != fold])
            scored += [(trees.score(x), x[0], p, t) for f, x, p, t in own if f == fold]
    return [Trees([(x, p, t) for _, x, p, t in own]) for own in kinds], thresholds(scored)


def thresholds(scored: list[tuple[float, int, float, float]]) -> dict[int, float]:
    """By kind, from (score, kind, positives, total): the least score, of 0 (as likely as not) at least, with a precision of PRECISION at least; absent if there is none."""
    out = {}
    for kind in range(len(KINDS)):
        p = t = 0.0
        own = sorted((x for x in scored if x[1] == kind), reverse=True)
        for i, (score, _, cp, ct) in enumerate(own):
            p, t = p + cp, t + ct
            # cells of one score stand or fall together
            if (i + 1 == len(own) or own[i + 1][0] < score) and (p + 0.5) / (t + 1) >= PRECISION:
                out[kind] = max(score, 0.0)
    return out


def detect(docs: DataFrame) -> DataFrame:
    """docs (text made non-null) with `spans`: array of (kind, start, end), base spans first; `base` alone; and `added`."""
    trees, least = train(docs)
    df = candidates(base_spans(docs))
    df = df.withColumn("added", F.expr("cast(array() AS array<struct<kind: string, start: bigint, end: bigint>>)"))
    passes = lambda k: lambda c: ~c["near_base"] & (trees[k].column(c) >= F.lit(least[k] - 1e-9))
    span = lambda kind: lambda z: F.struct(F.lit(kind).alias("kind"), z["c"]["start"].alias("start"), z["c"]["end"].alias("end"))
    for name, (kind, _) in GENERATORS.items():
        k = KINDS.index(kind)
        if k in least:
            df = df.withColumn("_new", F.filter(name, passes(k)))
            df = with_overlap(df, "_met", "_new", "added")
            clear = F.filter(F.arrays_zip(F.col("_new").alias("c"), F.col("_met").alias("m")), lambda z: ~z["m"])
            df = df.withColumn("added", F.concat("added", F.transform(clear, span(kind)))).drop("_new", "_met")
    return df.withColumn("added", F.array_sort("added")).withColumn("spans", F.concat("base", "added")).drop(*GENERATORS)


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with each span (overlapping ones as one) replaced by its kind in brackets; null texts stay null."""
    # all other columns travel in one, so that no name can clash
    df = detect(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    some = F.size("spans") > 0
    df = df.withColumn("cuts", order).withColumn("reach", F.when(some, _scan(F.transform("cuts", lambda s: -s["back"]), F.greatest, 0)))
    # of many spans, each would count through the text again
    df = df.withColumn("chars", F.when(F.size("cuts") > 100, F.split("text", "")))
    between = lambda a, n: F.when(F.col("chars").isNotNull(), F.array_join(F.slice("chars", (a + 1).cast("int"), n.cast("int")), "")).otherwise(F.substr("text", (a + 1).cast("int"), n.cast("int")))
    part = lambda z: F.when(z["s"]["start"] >= z["r"], F.concat(between(z["r"], z["s"]["start"] - z["r"]), F.lit("["), F.upper(z["s"]["kind"]), F.lit("]"))).otherwise("")
    end = F.array_max(F.transform("cuts", lambda s: -s["back"]))
    text = F.concat(F.array_join(F.transform(F.arrays_zip(F.col("cuts").alias("s"), F.col("reach").alias("r")), part), ""), F.substr("text", (end + 1).cast("int")))
    new = F.when(F.col("row.text").isNotNull() & some, text).otherwise(F.col("row.text"))
    return df.withColumn("new", new).select(*(F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *map(count, BASE), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op8_pii": op8_pii}
