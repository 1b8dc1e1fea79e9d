"""Toxicity: a logistic classifier with a counterfactual penalty.

Features are the words of a text (runs of letters, A-Z lower-cased) and their beginnings of 4, 5 and 6 bytes, each
present or not, twice or not, three times or not, as 64-bit hashes. Training takes at most SAMPLE labelled rows of each label, chosen by a hash of
doc_id (the documented bound); of their features the FEATURES with the strongest association to the label are kept.
For each sampled text two copies are made. If it names a group of IDENTITY: one with every mention swapped for another
group of the same kind, one without the mentions. If it names none: one with a mention put in, of each term in turn, and
one with the term's counterpart in its place, so that terms that start like words of the kept features can't score either. The features of both are taken anew, how often they occur included,
and the loss has, besides cross entropy and a ridge, the squares of the differences between the text's logit and
theirs. So a term's own weights, those of its second and third mention too, are driven to zero, and neutral mentions
of a group change no score. Terms are those of IDENTITY's four languages.

The score is the model's probability at the share of toxic rows among all labelled ones. Null and empty texts have no features and get the score of
the intercept. Labels that are null are no labels; a doc_id with several is toxic if one says so. Without both
labels in the training rows every score is 0. Repeated rows get equal scores; other columns pass through, but those
named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded, joined, slices, span_hash, spill, utf8, word_table

SAMPLE = 6000
FEATURES = 2048
STARTS = (4, 5, 6)
OFTEN = (2, 3)
THRESHOLD = 0.7
#: Groups of terms that may be swapped for one another, by kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    # German
    ("frauen", "männer", "mädchen", "jungen", "transpersonen"),
    ("frau", "mann"),
    ("weibliche", "männliche"),
    ("weiblichen", "männlichen"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwarzen", "weißen", "asiatischen", "afrikanischen", "europäischen"),
    ("schwarzer", "weißer", "asiatischer", "afrikanischer", "europäischer"),
    ("asiaten", "afrikaner", "europäer"),
    ("moslem", "muslimin", "christ", "christin", "jude", "jüdin", "buddhist", "atheist"),
    ("muslime", "moslems", "christen", "juden", "buddhisten", "atheisten"),
    ("muslimen", "juden"),
    ("muslimische", "christliche", "jüdische", "hinduistische", "buddhistische"),
    ("muslimischen", "christlichen", "jüdischen", "hinduistischen", "buddhistischen"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle", "homosexuelle"),
    ("schwulen", "lesbischen", "bisexuellen", "heterosexuellen", "homosexuellen"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"),
    ("einwanderer", "flüchtling", "ausländer", "einheimischer"),
    ("zuwanderer", "flüchtlinge", "migranten", "einheimische"),
    ("einwanderern", "flüchtlingen", "ausländern", "einheimischen"),
    ("gehörlose", "blinde", "behinderte", "autisten"),
    ("gehörlosen", "blinden", "behinderten"),
    # French
    ("femmes", "hommes", "filles", "garçons", "transgenres"),
    ("femme", "homme", "fille", "garçon"),
    ("féminin", "masculin"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("noir", "blanc", "asiatique", "africain", "européen", "arabe"),
    ("noires", "blanches", "africaines", "européennes"),
    ("noire", "blanche", "africaine", "européenne"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmane", "chrétienne", "juive", "hindoue"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulmanes", "chrétiennes", "juives", "hindoues"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels", "homosexuels"),
    ("lesbienne", "bisexuelle", "hétérosexuelle", "homosexuelle"),
    ("homosexuel", "bisexuel", "hétérosexuel"),
    ("immigré", "réfugié", "étranger", "autochtone"),
    ("immigrée", "réfugiée", "étrangère"),
    ("immigrés", "réfugiés", "étrangers", "autochtones", "migrants"),
    ("immigrées", "réfugiées", "étrangères"),
    ("sourds", "aveugles", "handicapés", "autistes"),
    ("sourd", "aveugle", "handicapé", "autiste"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños", "transexuales"),
    ("mujer", "hombre", "niña", "niño"),
    ("femenino", "masculino"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos", "gitanos"),
    ("negro", "blanco", "asiático", "africano", "europeo", "gitano"),
    ("negras", "blancas", "asiáticas", "latinas", "africanas", "europeas", "gitanas"),
    ("negra", "blanca", "asiática", "latina", "africana", "europea", "gitana"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmana", "cristiana", "judía", "atea"),
    ("cristianas", "judías", "ateas"),
    ("cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("lesbianas", "bisexuales", "heterosexuales", "homosexuales"),
    ("lesbiana", "heterosexual", "homosexual"),
    ("inmigrante", "refugiado", "extranjero", "nativo"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos", "migrantes"),
    ("refugiada", "extranjera", "nativa"),
    ("refugiadas", "extranjeras", "nativas"),
    ("sordos", "ciegos", "discapacitados", "autistas"),
    ("sordo", "ciego", "discapacitado", "autista"),
)
#: As the words of features(), in bytes with A-Z lower-cased.
WORD = re.compile(rb"[a-z\x80-\xff]+")
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word and word start, in text order."""
    raw, marks = joined(texts)
    a = word_table(letters_only=True)[raw]
    a[marks] = 32
    edge = np.diff((a != 32).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(marks, start) - 1
    hashes, owners = [span_hash(a, start, end)], [text]
    for k in STARTS:
        long = end - start >= k
        hashes.append(span_hash(a, start[long], start[long] + k) + np.uint64(k))
        owners.append(text[long])
    return np.concatenate(owners), np.concatenate(hashes)


def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As features(), each pair once; a feature that a text has 2 or 3 times gives one more for each."""
    t, h = features(texts)
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    times = np.diff(np.flatnonzero(np.append(new, True)))
    t, h = t[new], h[new]
    more = [times >= k for k in OFTEN]
    return np.concatenate([t, *[t[m] for m in more]]), np.concatenate([h, *[h[m] + np.uint64(16 * k) for k, m in zip(OFTEN, more, strict=True)]])


def swaps(identity: tuple[tuple[str, ...], ...]) -> dict[bytes, bytes]:
    """Each term to the next one of its kind; other letters than A-Z as they are, in capitals and in a capital first."""
    to: dict[bytes, bytes] = {}
    for kind in identity:
        for i, w in enumerate(kind):
            for form in (str.lower, str.upper, str.capitalize):
                to.setdefault(form(w).encode().lower(), form(kind[(i + 1) % len(kind)]).encode().lower())
    return to


def counterparts(texts: list[bytes], to: dict[bytes, bytes]) -> tuple[list[bytes], list[bytes], int]:
    """Two counterfactual copies of each text (see above), and how many of the texts name terms themselves."""
    terms = sorted(w for w in to if w == w.lower())
    a, b, naming = [], [], 0
    for text in texts:
        text = text.lower()
        if not terms:
            a.append(text)
            b.append(text)
        elif to.keys().isdisjoint(WORD.findall(text)):
            term = terms[xxhash.xxh3_64_intdigest(text) % len(terms)]
            a.append(text + b" " + term)
            b.append(text + b" " + to[term])
        else:
            naming += 1
            a.append(WORD.sub(lambda m: to.get(m[0], m[0]), text))
            b.append(WORD.sub(lambda m: b"" if m[0] in to else m[0], text))
    return a, b, naming


class Model:
    """Weights of the kept feature hashes, sorted by hash; how many pairs the penalty took, and of how many of these the
    kept features differ."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, n_pairs: int = 0, n_differ: int = 0):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.n_pairs, self.n_differ = n_pairs, n_differ
        self.near = np.zeros(1 << 16, bool)
        self.near[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def columns(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature number), each pair once."""
        t, h = distinct(texts)
        on = self.near[(h >> np.uint64(48)).astype(np.int64)]
        t, h = t[on], h[on]
        k = np.searchsorted(self.hashes, h)
        on = k < len(self.hashes)
        on[on] = self.hashes[k[on]] == h[on]
        pairs = np.unique(t[on].astype(np.int64) * len(self.hashes) + k[on])
        return pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        t, k = self.columns(texts)
        return 1 / (1 + np.exp(-(np.bincount(t, self.weights[k], len(texts)) + self.bias)))


LISTS = pa.list_(pa.int32())


def lists(model: Model, texts: list[bytes]) -> list[list[int]]:
    """The feature numbers of each text."""
    t, k = model.columns(texts)
    cut = np.searchsorted(t, np.arange(len(texts) + 1))
    return [k[cut[i] : cut[i + 1]].tolist() for i in range(len(texts))]


def fit(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, prior: float, swapped: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, ridge: float = 1e-5, counterfactual: float = 10.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted loss. x: (row, column) pairs; swapped: (pair, column, +1 or -1), by which the
    logit of a text differs from that of its counterfactual."""
    rows, cols = x
    pairs, diff, sign = swapped
    n_pairs = int(pairs.max()) + 1 if len(pairs) else 0
    share = np.where(y > 0, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(y)) + b)))
        r = share * (p - y)
        g = np.bincount(cols, r[rows], width) + ridge * w
        if n_pairs:
            gap = np.bincount(pairs, w[diff] * sign, n_pairs)
            g += np.bincount(diff, gap[pairs] * sign, width) * (2 * counterfactual / n_pairs)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def sample(docs: DataFrame, labels: DataFrame, size: int, held_in: Column | None) -> tuple[DataFrame, float]:
    """text and y of at most size rows of each label: the labelled ids are bounded first, then looked up. And the
    share of toxic ones among all labelled ids."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    ids = (known if held_in is None else known.filter(held_in)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    part = None
    for y in (0, 1):
        some = ids.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        part = some if part is None else part.unionByName(some)
    # at most 2 * size rows of two numbers
    rows = spill(docs.select("doc_id", "text").join(F.broadcast(part), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"))
    return rows, ids.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0] or 0.0


def counts(rows: DataFrame) -> DataFrame:
    """hash, n1, n0: in how many toxic and other rows a feature is; summed within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                y = batch.column("y").to_numpy(zero_copy_only=False)
                t, h = distinct(utf8(batch.column("text")))
                keys, k = np.unique(h, return_inverse=True)
                n1 = np.bincount(k, y[t] > 0, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n1), pa.array(np.bincount(k, minlength=len(keys)) - n1)], names=["hash", "n1", "n0"])

    return rows.select("text", "y").mapInArrow(run, "hash long, n1 long, n0 long").groupBy("hash").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def train(docs: DataFrame, labels: DataFrame, held_in: Column | None = None, size: int = SAMPLE, width: int = FEATURES, identity: tuple = IDENTITY, counterfactual: float = 10.0) -> Model:
    """Fits the model on a bounded sample of the rows that labels covers and held_in, a condition on doc_id, allows."""
    bounded(docs.sparkSession)
    rows, prior = sample(docs, labels, size, held_in)
    n = {r["y"] > 0: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1e3)
    p1, p0 = F.col("n1") / n1, F.col("n0") / n0
    strength = F.abs(p1 - p0) / F.sqrt((p1 + p0) / 2 * (1.0 / n1 + 1.0 / n0))
    top = counts(rows).filter(F.col("n1") + F.col("n0") >= 3).withColumn("z", strength).filter("z >= 3.5").orderBy(F.desc("z"), "hash").limit(width).collect()
    kept = np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
    to = swaps(identity)
    model = Model(kept, np.zeros(len(kept)), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = utf8(batch.column("text"))
                a, b, _ = counterparts(texts, to)
                held = [batch.column("y").cast(pa.int32()), *[pa.array(lists(shared.value, x), LISTS) for x in (texts, a, b)]]
                yield pa.RecordBatch.from_arrays(held, names=["y", "k", "a", "b"])

    # of 2 * size rows at most, kept features only
    found = rows.select("text", "y").mapInArrow(run, "y int, k array<int>, a array<int>, b array<int>").collect()
    y = np.array([float(r["y"] > 0) for r in found])
    sets = [set(r["k"]) for r in found]
    pair, diff, sign = [], [], []
    n_pairs = 0
    for s, r in zip(sets, found, strict=True):
        for other in (r["a"], r["b"]):
            for k in s.symmetric_difference(other):
                pair.append(n_pairs)
                diff.append(k)
                sign.append(1.0 if k in s else -1.0)
            n_pairs += 1
    rows_, cols = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([k for s in sets for k in sorted(s)], np.int64)
    differ, pair = np.unique(np.array(pair, np.int64), return_inverse=True)  # the mean is over pairs that differ at all
    w, b = fit((rows_, cols), y, prior, (pair, np.array(diff, np.int64), np.array(sign)), len(kept), counterfactual=2 * counterfactual)  # two pairs for a text
    return Model(kept, w, b, n_pairs, len(differ))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        p = shared.value.scores(utf8(batch.column(text)))
        return [p, (p >= threshold).astype(np.int32)]

    return append_columns(docs, RESULT, text, make)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
