"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts, which give a document's likelihoods as a toxic and as an ordinary one."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, extended, pick, sealed

#: Longest n-gram of characters; absolute discount; share of an unseen character.
ORDER, DISCOUNT, UNSEEN = 7, 0.9, 1e-3
#: Most labelled rows and bytes of their texts that the models and the calibration are learnt from; texts over a 64th of the bytes are left out.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: (characters that an expression's evidence is scaled to, share of toxic expressions in a toxic document): calibration takes the likeliest.
RULES = [(scale, share) for scale in (4.0, 6.0) for share in (2e-2, 1e-2, 3e-3)]
#: Expressions that a task remembers in each of two generations, of so many characters at most.
MEMORY, LONGEST = 150_000, 64
START, END = "\x02", "\x03"
EXPRESSION = re.compile(r"[^\W\d_]+")


def expressions(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return EXPRESSION.findall((text or "").lower())


def grams(expression: str) -> list[str]:
    """For each character and the end, it and up to ORDER - 1 characters before, the start mark among them."""
    marked = START + expression + END
    return [marked[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(marked))]


def _contexts(counts: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each context, the count of its n-grams and the number of different ones."""
    total, kinds = defaultdict(int), defaultdict(int)
    for gram, n in counts.items():
        total[gram[:-1]] += n
        kinds[gram[:-1]] += 1
    return {h: (n, kinds[h]) for h, n in total.items()}


def fitted(counts: dict[str, tuple[int, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Log ratios of the toxic to the ordinary model, of seen n-grams and of contexts; counts: (ordinary, toxic) by n-gram.

    Each class counts its own n-grams of the highest order (shorter ones only where they
    begin an expression). Both back off to one Kneser-Ney model of shorter n-grams, whose counts are the numbers of
    different characters before them in either class; so what is rare in both
    scores alike in both. Of an unseen n-gram the shared backoff cancels out, and its context's ratio is left.
    """
    own = [{g: c[y] for g, c in counts.items() if c[y]} for y in (0, 1)]
    contexts = [_contexts(c) for c in own]
    shared: dict[str, int] = defaultdict(int)
    level = set(counts)
    while level:
        below = [g[1:] for g in level if len(g) > 1]
        for gram in below:
            shared[gram] += 1
        level = set(below)
    shared_contexts = _contexts(shared)

    def backoff(gram: str) -> float:
        p = UNSEEN
        for i in range(len(gram) - 1, -1, -1):
            part = gram[i:]
            if seen := shared_contexts.get(part[:-1]):
                p = (max(shared.get(part, 0) - DISCOUNT, 0.0) + DISCOUNT * seen[1] * p) / seen[0]
        return p

    def probability(gram: str, label: int, p: float) -> float:
        seen = contexts[label].get(gram[:-1])
        return p if not seen else (max(own[label].get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * seen[1] * p) / seen[0]

    def weight(context: str, label: int) -> float:
        seen = contexts[label].get(context)
        return 1.0 if not seen else DISCOUNT * seen[1] / seen[0]

    of_gram = {g: math.log(probability(g, 1, p) / probability(g, 0, p)) for g in counts for p in (backoff(g[1:]),)}
    return of_gram, {h: math.log(weight(h, 1) / weight(h, 0)) for h in {*contexts[0], *contexts[1]}}


def ratio(tables: tuple[dict[str, float], dict[str, float]], expression: str) -> float:
    """Toxic minus ordinary log-likelihood of an expression, by its length."""
    of_gram, of_context = tables
    total = 0.0
    for gram in grams(expression):
        own = of_gram.get(gram)
        total += of_context.get(gram[:-1], 0.0) if own is None else own
    return total / (len(expression) + 1)


def term(by_length: float, scale: float, share: float) -> float:
    """What an expression adds to its document's log-likelihood ratio: a toxic document's expressions are toxic with chance `share`, else ordinary."""
    return math.log1p(share * math.expm1(min(50.0, scale * by_length)))


def _of_each(text: str | None, known: list[dict[str, float]], make) -> list[float]:
    """make(expression) of a text's distinct expressions. known: those so far, of two generations; the older goes when the younger is full."""
    if len(known[0]) > MEMORY:
        known[:] = {}, known[0]
    young, old = known
    out = []
    for e in set(expressions(text)):
        x = young.get(e)
        if x is None:
            x = old.get(e)
            if x is None:
                x = make(e)
            if len(e) <= LONGEST:
                young[e] = x
        out.append(x)
    return out


def evidence(tables, text: str | None, rule: tuple[float, float], known: list[dict[str, float]]) -> float:
    """The document's log-likelihood as a toxic one less that as an ordinary one, over its distinct expressions, each normalised by length; 0 without any."""
    return math.fsum(_of_each(text, known, lambda e: term(ratio(tables, e), *rule)))


def probability(found: float, slope: float, offset: float) -> float:
    """The calibrated probability of label 1."""
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, slope * found + offset))))


def calibrated(found: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset by penalised logistic regression (Newton steps), and the mean log-likelihood of the labels under them.

    Without both labels, or if the evidence speaks against the labels, a slope and offset that reject next to nothing.
    """
    if len(set(labels.tolist())) < 2:
        return 4.0, -5.0, -math.inf
    x, w = np.column_stack([found, np.ones(len(found))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-6]), x.T @ (labels - p) - np.array([0.05, 0.0]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    if not w[0] > 0:
        return 4.0, -5.0, -math.inf
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -50, 50))), 1e-12, 1 - 1e-12)
    return float(w[0]), float(w[1]), float(np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))))


def bucket(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _document_grams(batches):
    for batch in batches:
        keys, labels = [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for gram in {g for e in set(expressions(text)) for g in grams(e)}:
                keys.append(gram)
                labels.append(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(labels, pa.int32())], ["gram", "toxic"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, held_out: int = 2) -> dict:
    """What `with_scores` needs (tables, rule, slope, offset), learnt from at most `sample` labelled rows outside the held-out bucket.

    Those of least hash of doc_id are taken, so that the choice does not depend
    on the tables' order; of labels that contradict each other, the larger. Texts count once for a label, in the order of their hash, until
    `sample_bytes` are full. A fifth of them, by another hash of the text, chooses the rule and calibrates the score; the others'
    n-grams are counted where the texts are, and
    only the counts, whose number the sample bounds, come to the driver. Rows without id, label
    or text take no part; without labels of both kinds, scores stay near 0.
    """
    scratch = Scratch(docs.sparkSession)
    marks = pick(labels, doc_id="doc_id", toxic="toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.filter(bucket(F.col("doc_id")) != held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, doc_id="doc_id", text="text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= sample_bytes // 64))
    rows = rows.join(F.broadcast(marks), "doc_id").select("text", "toxic", F.xxhash64("text").alias("hash"))
    kept = scratch.keep(rows.dropDuplicates(["text", "toxic"]))
    first = kept.select("hash", F.octet_length("text").alias("size")).orderBy("hash", "size").limit(sample)
    upto = F.sum("size").over(Window.orderBy("hash", "size"))  # of `sample` narrow rows at most
    last = first.select("hash", upto.alias("upto")).filter(F.col("upto") <= sample_bytes).agg(F.max("hash")).first()[0]
    rows = kept.filter(F.col("hash") <= last) if last is not None else kept.limit(0)
    apart = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(5)) == 0
    counted = rows.filter(~apart).select("text", "toxic").mapInArrow(_document_grams, "gram string, toxic int")
    counted = counted.groupBy("gram").agg(F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))
    tables = fitted({r.gram: (r.ordinary, r.toxic) for r in counted.toLocalIterator()})
    check = rows.filter(apart).select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    seen = [(*r.evidence, r.toxic) for r in check.mapInArrow(_evidences(shared), "evidence array<double>, toxic int").collect()]  # a fifth of the sample
    seen = np.array(seen, float).reshape(-1, len(RULES) + 1)
    chosen = max(((calibrated(seen[:, i], seen[:, -1]), rule) for i, rule in enumerate(RULES)), key=lambda x: x[0][2])
    shared.destroy()
    scratch.drop(kept)
    return {"tables": tables, "rule": chosen[1], "slope": chosen[0][0], "offset": chosen[0][1]}


def _evidences(shared):
    def run(batches):
        known, tables = [{}, {}], shared.value
        for batch in batches:
            ratios = [_of_each(text, known, lambda e: ratio(tables, e)) for text in batch.column("text").to_pylist()]
            found = [[math.fsum(term(r, *rule) for r in own) for rule in RULES] for own in ratios]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], ["evidence", "toxic"])

    return run


def _scored(shared, rule: tuple[float, float], slope: float, offset: float):
    def run(batches):
        known, tables = [{}, {}], shared.value
        for batch in batches:
            scores = [probability(evidence(tables, text, rule, known), slope, offset) for text in batch.column("text").to_pylist()]
            yield batch.append_column("_score", pa.array(scores, pa.float64()))

    return run


def with_scores(docs: DataFrame, model: dict) -> DataFrame:
    """The documents, columns c0, c1, ... but for text, with _score behind.

    Whole texts are scored one by one where they are; nothing is shuffled. The model's tables
    are broadcast: the sample bounds their size. Null and empty texts, and those without letters, have
    the score of no evidence.
    """
    plain, _, new = sealed(docs)
    rows = plain.withColumnRenamed(new["text"], "text")
    shared = docs.sparkSession.sparkContext.broadcast(model["tables"])  # of plain types, so that workers need no package
    return rows.mapInArrow(_scored(shared, model["rule"], model["slope"], model["offset"]), extended(rows, "_score", "double"))


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, held_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each document row.

    score is the probability of label 1 (see `fitted`, `term` and `evidence`); predicted is 1 from `threshold` on.
    Repeated rows are scored each; a null doc_id is not held out. Null and empty texts have the score of no evidence. An empty table gives none.
    """
    rows = pick(docs, doc_id="doc_id", text="text")
    scored = with_scores(rows, train(docs, labels, sample=sample, held_out=held_out)).toDF("doc_id", "text", "score")
    out = F.coalesce(bucket(F.col("doc_id")) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is below the threshold; columns and rows as given, repeated ones each.

    Null and empty texts, and rows without doc_id, are scored like others: the former have no evidence. An empty table gives none.
    """
    scored = with_scores(docs, train(docs, labels, sample=sample))
    return scored.filter(F.col("_score") < threshold).drop("_score").toDF(*docs.columns)
