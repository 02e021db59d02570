"""Operator 5: mixing documents to target weights by soft membership. DataFrame functions only.

A naive Bayes classifier with Gaussian features, whose moments come from all labelled rows, gives each document a
posterior over domains (clean, low, toxic). With t_d words and posteriors p_dk, document d at rate r_d adds r_d t_d p_dk to
domain k. Projected gradient finds rates r >= 0 that minimise the weighted squares of totals minus targets: each
round adds the domain totals up over all documents (a handful of numbers), and moves r_d by -p_d . M residual, M
being the inverse of sum t_d p_d p_d', with which a step of 1 is never too long; then r_d is cut at its lower bound:
0, or, where documents judged likeliest clean are to stay, 1 for those. Rounds run on from where the last two point
(accelerated gradient), and start afresh where that overshoots. The lexicon of the features has at most
LEXICON words, found in a bounded sample of labelled rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import keep

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
_WORD = r"[^\x20\x09-\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "clean")


def features(text: Column, lexicon: list[str]) -> list[Column]:
    """Words, and logarithms of rates per word: symbols, capitals, line ends, letters, lexicon words."""
    text = F.coalesce(text, F.lit(""))
    n = F.regexp_count(text, F.lit(_WORD))
    rate = lambda count: F.log1p(1000 * count / F.greatest(n, F.lit(1)))
    hits = F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(lexicon) + r")\b")) if lexicon else F.lit(0)
    return [n.cast("long").alias("t"), rate(F.regexp_count(text, F.lit(r"[!%&$*#@|<>{}0-9]"))).alias("f0"), rate(F.regexp_count(text, F.lit("[A-Z]"))).alias("f1"), rate(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("f2"), F.log1p(F.char_length(text) / F.greatest(n, F.lit(1))).alias("f3"), rate(hits).alias("f4")]


N_FEATURES, LEXICON = 5, 40


def find_lexicon(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int = 4000, size: int = LEXICON) -> list[str]:
    """Words of letters that mark toxic documents in a sample of at most sample_rows labelled rows."""
    d = labels.select(F.col(id_col).alias("_id"), (domain_of(F.col("quality"), F.col("toxic")) == "toxic").alias("bad")).where("bad is not null and _id is not null")
    half = [d.where(F.col("bad") == b).orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(sample_rows // 2) for b in (True, False)]
    ids = half[0].union(half[1]).groupBy("_id").agg(F.max("bad").alias("bad"))
    w = docs.join(F.broadcast(ids), docs[id_col] == ids["_id"]).select("bad", F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"))).alias("w")).where("length(w) > 2")
    c = w.groupBy("w").agg(F.count_if("bad").alias("x"), F.count_if(~F.col("bad")).alias("y")).where("x >= 5 and x > 20 * y")
    return [r["w"] for r in c.orderBy(F.desc("x"), "w").limit(size).collect()]


class Mixer:
    """Fitted constants: posterior and rate are expressions of the features. residual: the largest miss of a domain's total, as a share of all."""

    def __init__(self, lexicon, moments, steps, keep_clean: bool = False):
        self.lexicon, self.moments, self.steps, self.keep_clean, self.residual = lexicon, moments, steps, keep_clean, 0.0

    def log_likelihoods(self) -> list[str]:
        out = []
        for k in DOMAINS:
            prior, means, variances = self.moments[k]
            terms = [f"pow(f{i} - ({m!r}D), 2) / {2 * v!r}D" for i, (m, v) in enumerate(zip(means, variances, strict=True))]
            constant = prior - sum(0.5 * _log(v) for v in variances)
            out.append(f"({constant!r}D - ({' + '.join(terms)}))")
        return out

    def with_posteriors(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({f"l{k}": F.expr(x) for k, x in enumerate(self.log_likelihoods())})
        df = df.withColumn("lm", F.greatest(*[F.col(f"l{k}") for k in range(len(DOMAINS))]))
        df = df.withColumns({f"e{k}": F.exp(F.col(f"l{k}") - F.col("lm")) for k in range(len(DOMAINS))})
        total = sum((F.col(f"e{k}") for k in range(1, len(DOMAINS))), F.col("e0"))
        return df.withColumns({f"p{k}": F.col(f"e{k}") / total for k in range(len(DOMAINS))}).drop("lm", *[f"{c}{k}" for c in "le" for k in range(len(DOMAINS))])

    def rate(self) -> Column:
        if not self.steps:
            return F.lit(1.0)
        steps = ", ".join("array(" + ", ".join(f"{x!r}D" for x in s) + ")" for s in self.steps)
        move = " + ".join(f"p{k} * s[{k}]" for k in range(len(DOMAINS)))
        low = "if(" + " and ".join(f"p0 >= p{k}" for k in range(1, len(DOMAINS))) + ", 1.0D, 0.0D)" if self.keep_clean else "0.0D"
        onward = f"a.r + s[{len(DOMAINS)}] * (a.r - a.q) - ({move})"
        return F.expr(f"aggregate(array({steps}), named_struct('r', 1.0D, 'q', 1.0D), (a, s) -> named_struct('r', greatest({low}, {onward}), 'q', a.r), a -> a.r)")


def _log(x: float) -> float:
    import math

    return math.log(x)


def _inverse(a: list[list[float]]) -> list[list[float]]:
    """Gauss-Jordan inverse of a small positive matrix, with a little added to its diagonal."""
    n = len(a)
    ridge = 1e-9 * max(1e-9, sum(a[i][i] for i in range(n)))
    m = [[*map(float, row), *[float(i == j) for j in range(n)]] for i, row in enumerate(a)]
    for i in range(n):
        m[i][i] += ridge
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        m[i] = [x / m[i][i] for x in m[i]]
        for r in range(n):
            if r != i:
                m[r] = [x - m[r][i] * y for x, y in zip(m[r], m[i], strict=True)]
    return [row[n:] for row in m]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, rounds: int = 60, tolerance: float = 1e-4, keep_clean: bool = False, rows: bool = False) -> tuple[Mixer, DataFrame]:
    """(mixer, a written table of id, t, posteriors p0.. for each row of docs). rows: the features' table holds the row itself too, as a struct.

    The targets are shares of the expected words of each domain; their total is what keeps the first domain at its own size.
    Rounds go on until the totals meet the targets, or the squares hardly fall any more (no rates may meet them: no
    document of some domain, say), or `rounds` are over. The mixer's residual tells by how much they are missed.
    """
    targets = targets or TARGETS
    lexicon = find_lexicon(docs, labels, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain"))  # toxic > low > clean
    table = keep(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), *features(F.col(text_col), lexicon), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * rows), "features")
    found = {r["domain"]: r for r in table.join(known, "doc_id").groupBy("domain").agg(F.count("*").alias("c"), *[f(f"f{i}").alias(f"{n}{i}") for i in range(N_FEATURES) for n, f in (("m", F.avg), ("v", F.var_pop))]).collect()}
    total = sum(r["c"] for r in found.values())
    moments = {}
    for k in DOMAINS:
        r = found.get(k)
        c = r["c"] if r else 0
        moments[k] = (_log((c + 1) / (total + len(DOMAINS))), [float(r[f"m{i}"]) if r else 0.0 for i in range(N_FEATURES)], [max(0.05, float(r[f"v{i}"])) if r else 100.0 for i in range(N_FEATURES)])
    mixer = Mixer(lexicon, moments, [], keep_clean)
    mixer.table = table
    held = keep(mixer.with_posteriors(table).select("doc_id", "h", "t", *[f"p{k}" for k in range(len(DOMAINS))]), "posteriors")
    n = len(DOMAINS)
    first = held.agg(*[F.sum(F.col("t") * F.col(f"p{k}")).alias(f"s{k}") for k in range(n)], *[F.sum(F.col("t") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"a{i}{j}") for i in range(n) for j in range(i, n)]).first()
    sums = [float(first[f"s{k}"] or 0) for k in range(n)]
    m = _inverse([[float(first[f"a{min(i, j)}{max(i, j)}"] or 0) for j in range(n)] for i in range(n)])
    whole = sums[0] / targets[DOMAINS[0]]
    goal = [targets[k] * whole for k in DOMAINS]
    squares: list[float] = []
    last, run = sums, 0
    while True:
        off = [x - g for x, g in zip(sums, goal, strict=True)]
        mixer.residual = max(map(abs, off)) / max(1.0, whole)
        squares.append(sum(off[i] * m[i][j] * off[j] for i in range(n) for j in range(n)))
        if mixer.residual <= tolerance or len(squares) > rounds or len(squares) > 6 and min(squares[-6:]) >= 0.99 * min(squares[:-6]):
            break
        run = 0 if len(squares) > 1 and squares[-1] > squares[-2] else run + 1
        beta = (run - 1) / (run + 2) if run > 1 else 0.0
        rest = [x + beta * (x - y) - g for x, y, g in zip(sums, last, goal, strict=True)]
        mixer.steps.append([*[sum(m[i][j] * rest[j] for j in range(n)) for i in range(n)], beta])
        r = held.select("t", mixer.rate().alias("r"), *[f"p{k}" for k in range(n)]).agg(*[F.sum(F.col("r") * F.col("t") * F.col(f"p{k}")).alias(f"s{k}") for k in range(n)]).first()
        last, sums = sums, [float(r[f"s{k}"] or 0) for k in range(n)]
    return mixer, held


def copies(rate: Column, doc_id: Column, h: Column) -> Column:
    """Whole copies whose expected number is the rate."""
    u = F.pmod(F.xxhash64(doc_id, h, F.lit(3)), F.lit(1_000_000)) / 1_000_000
    return F.floor(rate + u).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None) -> DataFrame:
    """One row per row of docs: (id_col, n_words, p_clean, p_low, p_toxic, rate, copies, residual); residual is the fit's, see fit().

    Null texts are empty: no words, posteriors from the features of an empty text. Null ids are kept; labels without a document, and null ones, are
    left out. Without labels every posterior is the prior. Extra columns are not read.
    """
    mixer, held = fit(docs, labels, id_col, text_col, targets)
    rate = mixer.rate()
    return held.select(F.col("doc_id").alias(id_col), F.col("t").alias("n_words"), *[F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(DOMAINS)], rate.alias("rate"), copies(rate, F.col("doc_id"), F.col("h")).alias("copies"), F.lit(mixer.residual).alias("residual"))


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, keep_clean: bool = False) -> DataFrame:
    """docs with each row as often as its rate says, with docs' own columns, whatever their names; repeated rows count each.

    keep_clean: rates of documents that are likeliest of the first domain are 1 at least, and the fit makes up for it
    with the others. Rows travel beside their features in one written table, so no text is read twice or shuffled.
    """
    mixer, _ = fit(docs, labels, id_col, text_col, targets, keep_clean=keep_clean, rows=True)
    # the row number keeps the filter above the select: pushed down, it would repeat the posteriors for each use
    out = mixer.with_posteriors(mixer.table).select("row", copies(mixer.rate(), F.col("doc_id"), F.col("h")).alias("copies"), F.monotonically_increasing_id().alias("at")).where("copies > 0 and at >= 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
