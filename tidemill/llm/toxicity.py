"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text and one on toxic text.  A window is a word with the blanks
around it, or a word's beginning with the blank before it, in UTF-32: a match costs zstandard about six bytes, more than a
short word in UTF-8 can save, but in UTF-32 every matched letter saves four, so compressed lengths tell known
words from unknown ones.  A window is toxic if the toxic dictionary compresses it to no more than a whole match takes and clearly
better than the ordinary one does.  A document's evidence is the number of its distinct toxic windows less an allowance
for each distinct window it has, so long texts need more; the threshold and the allowance, calibrated on labelled rows that trained no
dictionary, become the score 0.7.

A dictionary holds the windows that most texts of its label have, up to its size; the toxic one is made of what the
ordinary one can't compress, and windows that ordinary training texts share with it are added to the ordinary one.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the training sample: rows of each label, read whole.
TOXIC_ROWS, ORDINARY_ROWS = 1500, 4000
#: Bytes of the ordinary dictionary.  The toxic one starts at TOXIC_BYTES and is doubled as long as held-back texts gain by it.
ORDINARY_BYTES, TOXIC_BYTES = 1_048_576, 512
#: Compressed bytes of a window that is one match, and the bytes that the toxic dictionary must save against the ordinary one.
WHOLE, SAVED = 17, 2
#: Allowances for each distinct window of a text, among which calibration chooses.
ALLOWANCES = (0.0, 1 / 1000, 1 / 300, 1 / 100)
REMEMBERED = 120_000


def encoded(window: str) -> bytes:
    return window.encode("utf-32-le", "surrogatepass")


def windows_of(token: str) -> list[str]:
    word = "".join(c for c in token if c.isalpha())
    return [f" {word} "] * bool(word) + [f" {word[:4]}"] * (len(word) > 4) + [f" {word[:5]}"] * (len(word) > 5)


def windows(text: str) -> set[str]:
    return {w for token in set(text.lower().split()) for w in windows_of(token)}


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor that finds every window of the dictionary: a search tree as deep as need be, without optimal parsing.
    The library does not search a dictionary's last bytes, so zeros follow them."""
    raw = zstandard.ZstdCompressionDict(dictionary + bytes(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=23, chain_log=22, hash_log=20, search_log=20, min_match=6, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(compression_params=how, dict_data=raw)


def train(texts_with: Counter, size: int) -> bytes:
    """A dictionary of the windows that most texts have, the commonest last, where matches are cheapest.  Equal counts
    are ordered by CRC-32: in alphabetical order the search tree would become a list."""
    chosen = []
    for w in sorted(texts_with, key=lambda w: (-texts_with[w], zlib.crc32(encoded(w)), w)):
        size -= len(encoded(w))
        if size < 0:
            break
        chosen.append(encoded(w))
    return b"".join(reversed(chosen))


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, threshold: int = 1, allowance: float = 0.0):
        self.ordinary, self.toxic, self.threshold, self.allowance, self.known = ordinary, toxic, threshold, allowance, {}

    def __getstate__(self):
        return self.ordinary, self.toxic, self.threshold, self.allowance

    def __setstate__(self, state):
        self.__init__(*state)

    def is_toxic(self, window: str) -> bool:
        if not hasattr(self, "pair"):
            self.pair = compressor(self.ordinary), compressor(self.toxic)
        text = encoded(window)
        toxic = len(self.pair[1].compress(text))
        return toxic <= WHOLE and len(self.pair[0].compress(text)) - toxic >= SAVED

    def of_token(self, token: str) -> tuple[tuple[str, bool], ...]:
        """The token's windows, each with its verdict; kept for tokens met before, up to a bound."""
        found = self.known.get(token)
        if found is None:
            found = tuple((w, self.is_toxic(w)) for w in windows_of(token))
            if len(self.known) < REMEMBERED:
                self.known[token] = found
        return found

    def counted(self, text: str) -> tuple[int, int]:
        """Distinct toxic windows and distinct windows of a text."""
        found = {x for token in set(text.lower().split()) for x in self.of_token(token)}
        return sum(hit for _, hit in found), len(found)

    def score(self, text: str) -> float:
        hits, n = self.counted(text) if self.toxic else (0, 0)
        beyond = hits - self.allowance * n - self.threshold
        return 0.5 + 0.5 * math.tanh((math.log(7 / 3) + 1e-9 + beyond) / 2)


def calibrated(seen: list[tuple[int, int, int]]) -> tuple[float, int, float]:
    """F1, threshold and allowance that part (hits, windows, label) best; of equals the smallest."""
    toxic, best = sum(y for _, _, y in seen), (-1.0, 0, 0.0)
    for allowance in ALLOWANCES:
        for k in range(1, max(h for h, _, _ in seen) + 2):
            flagged = [y for h, n, y in seen if h - allowance * n - k >= 0]
            best = max(best, (2 * sum(flagged) / max(len(flagged) + toxic, 1), -k, -allowance))
    return best[0], -best[1], -best[2]


def fit(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from three quarters of the rows; threshold, allowance and the toxic dictionary's size from the rest (from all if it
    has few toxic): sizes are doubled until the dictionary holds every window or two doublings fell below the best F1; of equals the largest
    is taken, as it knows most windows."""
    fitting, rest = [r for k, r in enumerate(rows) if k % 4], rows[::4]
    if sum(y for _, y in rest) < 5:
        fitting = rest = rows
    texts_with, n = (Counter(), Counter()), Counter(y for _, y in fitting)
    for text, y in fitting:
        texts_with[y].update(windows(text))
    if not texts_with[1]:
        return Model(b"", b"")
    plain = train(texts_with[0], ORDINARY_BYTES)
    squeeze = compressor(plain)
    new = Counter({w: c for w, c in texts_with[1].items() if len(squeeze.compress(encoded(w))) >= WHOLE + SAVED})
    best, since, size = None, 0, TOXIC_BYTES
    while since < 2:
        toxic = train(new, size)
        model = Model(plain, toxic)
        hit = [w for w in texts_with[1] if texts_with[0][w] and model.is_toxic(w)]
        shared = Counter({w: texts_with[0][w] for w in hit if 4 * texts_with[0][w] * n[1] >= texts_with[1][w] * n[0]})
        model = Model(plain + train(shared, 4 * sum(map(len, shared))), toxic)
        f1, threshold, allowance = calibrated([(*model.counted(t), y) for t, y in rest])
        if best is None or f1 >= best[0]:
            best, since = (f1, Model(model.ordinary, toxic, threshold, allowance)), 0
        else:
            since += 1
        if size >= 4 * sum(map(len, new)):
            break
        size *= 2
    return best[1]


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample: the labelled rows not held out that come first by a hash of the id.
    Rows with a null id, text or label do not train; of several labels for an id the largest counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    chosen = cut(parts[0].unionByName(parts[1]), "toxicity-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "y").collect()
    return fit([(r.text, r.y) for r in sorted(rows, key=lambda r: (hashlib.md5(str(r.id).encode()).digest(), r.text))])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``score`` per row; null and empty texts have no evidence.  An empty table gives no rows."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t or "") for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``limit``, with all their columns."""

    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t or "") < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
