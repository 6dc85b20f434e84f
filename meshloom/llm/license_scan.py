"""License scan with a positional index of rare words.

1. One pass over the texts notes each file's licence words: which there are and, where all words of a mandatory key
   phrase of some template are there, the places of all of them (a positional index; other files have no licence).
2. Document frequencies of the licence words are counted over all files from these notes.
3. Each file is looked up in an index of all templates: from the rarest of its licence words on, the postings (template, place)
   of each word are met with the word's places in the file, until each possible template has met ``RAREST`` words. A place less a
   posting's place is where that template would start; starts on which at least ``AGREE`` words agree (all of them, if there are fewer)
   are candidates. Words put in or left out of a notice move the later words alone, so a part of it still agrees. A template is possible
   if the file has the words of its key phrases, and is found under the rarest of these, so others are never touched.
4. A candidate counts if every key phrase of the template stands within its stretch, word for word. Its score is
   the share of the template's weight in IDF that stands in place.

Templates are full texts or the notices that stand for them in files; short phrases and SPDX lines are templates too, whose key
phrase is nearly all of them.

Passes 2 to 4 read the notes alone, never the texts. No file, place or template is capped.

Defined results: a null text is the empty text, without words, labels or places, score 0; a file with base places, but no
template scores 1; repeated rows and ids are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common
from meshloom.llm.licence_texts import TEMPLATES

#: Base phrases: label and words.
PHRASES: tuple[tuple[str, str], ...] = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Words by which a file is looked up for one template, and how many of them must agree on where it starts.
RAREST, AGREE = 8, 3
#: Words by which a notice may be longer than its template, as a share of the template and at least.
ROOM, LEAST_ROOM = 0.2, 4
BATCH = 512

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in tokens(text)})
NUMBER = {w: i for i, w in enumerate(VOCABULARY)}
LABELS = [label for label, _, _ in TEMPLATES]
#: Templates and their key phrases as numbers of words.
WORDS = [[NUMBER[w] for w in tokens(text)] for _, text, _ in TEMPLATES]
KEYS = [[[NUMBER[w] for w in tokens(k)] for k in keys] for _, _, keys in TEMPLATES]
#: Words that a file must have for each template, and templates by the one of these that fewest templates need.
NEEDED = [frozenset(w for k in keys for w in k) for keys in KEYS]
_USES = Counter(w for need in NEEDED for w in need)
FIRST: dict[int, list[frozenset[int]]] = defaultdict(list)
for _need in NEEDED:
    FIRST[min(_need, key=lambda w: (_USES[w], w))].append(_need)
PLACES = [(label, tokens(p)) for label, p in PHRASES]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of each base phrase, overlapping ones included."""
    out = []
    for label, p in PLACES:
        last, at = len(words) - len(p), -1
        while True:
            try:
                at = words.index(p[0], at + 1, last + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                out.append((at, label))
    return out


def noted(words: list[bytes]) -> tuple[list[int], list[int] | None]:
    """The numbers of the licence words in a file, and their places (word, place, word, place, ...) if a template is possible."""
    have = {NUMBER[w] for w in NUMBER.keys() & set(words)}
    if not any(need <= have for w in have & FIRST.keys() for need in FIRST[w]):
        return sorted(have), None
    where = []
    for at, w in enumerate(words):
        n = NUMBER.get(w)
        if n is not None:
            where += (n, at)
    return sorted(have), where


NOTES = "n_words long, n_base long, first_word long, last_word long, base_labels string, present array<int>, places array<int>"


def _note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 2
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch, rows = whole.slice(at, BATCH), []
            for text in batch.column("text"):
                words = tokens(text.as_py())
                base = base_places(words)
                starts = [s for s, _ in base]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in base})), *noted(words)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *(f.split()[0] for f in NOTES.split(", "))])


def inverse_frequencies(notes: DataFrame) -> list[float]:
    """IDF of the licence words over all files: no more numbers than there are licence words."""
    n = notes.count()
    found = dict(notes.select(F.explode("present").alias("w")).groupBy("w").count().collect())
    return [math.log((n + 1) / (found.get(i, 0) + 0.5)) for i in range(len(VOCABULARY))]


class Index:
    """Posting lists of templates by word and place, and what a lookup needs of each; words are numbers with their IDF."""

    def __init__(self, idf: list[float], words: list[list[int]] = WORDS, keys: list[list[list[int]]] = KEYS, labels: list[str] = LABELS):
        self.idf, self.words, self.keys, self.labels = idf, words, keys, labels
        self.needed = [frozenset(w for k in ks for w in k) for ks in keys]
        self.weight = [sum(max(idf[w], 0.1) for w in ws) for ws in words]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.under: dict[int, list[int]] = defaultdict(list)
        for i, ws in enumerate(words):
            for at, w in enumerate(ws):
                self.postings[w].append((i, at))
            self.under[min(self.needed[i], key=self.rank)].append(i)

    def rank(self, w: int) -> tuple[float, int]:
        return -self.idf[w], w

    def starts(self, where: dict[int, list[int]]) -> dict[tuple[int, int], int]:
        """(template, start) of all candidates in a file; ``where``: the places of its licence words."""
        met = {i: 0 for w in where for i in self.under.get(w, ()) if self.needed[i] <= where.keys()}
        open_, votes = set(met), Counter()
        for w in sorted(where, key=self.rank):
            if not open_:
                break
            hits = [(i, at) for i, at in self.postings.get(w, ()) if i in open_]
            votes.update({(i, place - at) for i, at in hits for place in where[w]})
            for i in {i for i, _ in hits}:
                met[i] += 1
                if met[i] == RAREST:
                    open_.remove(i)
        return {c: n for c, n in votes.items() if n >= min(AGREE, met[c[0]])}


def match(places: list[int], index: Index) -> tuple[set[str], float]:
    """Labels of the templates that a file has, and the best share of a template's weight in place; ``places`` as in ``noted``."""
    at_place = dict(zip(places[1::2], places[0::2], strict=True))
    where: dict[int, list[int]] = defaultdict(list)
    for at, w in at_place.items():
        where[w].append(at)
    labels, score = set(), 0.0
    stands: dict[int, list[list[int]]] = {}
    for i, start in index.starts(where):
        words, keys = index.words[i], index.keys[i]
        if i not in stands:
            stands[i] = [[s for s in where[k[0]] if all(at_place.get(s + j) == w for j, w in enumerate(k))] for k in keys]
        room = max(LEAST_ROOM, int(ROOM * len(words)))
        if all(any(start - room <= s and s + len(k) <= start + len(words) + room for s in found) for k, found in zip(keys, stands[i], strict=True)):
            labels.add(index.labels[i])
            score = max(score, sum(max(index.idf[w], 0.1) for j, w in enumerate(words) if at_place.get(start + j) == w) / index.weight[i])
    return labels, score


def _matcher(idf: list[float]):
    index = Index(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [], []
            for base, places in zip(batch.column("base_labels").to_pylist(), batch.column("places"), strict=True):
                found, score = match(places.as_py(), index) if places.is_valid else (set(), 0.0)
                labels.append(",".join(sorted(found | (set(base.split(",")) if base else set()))))
                scores.append(float(1.0 if base and not found else min(score, 1.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "labels", "score"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    notes = common.written(docs.select("doc_id", "text").mapInArrow(_note, f"doc_id {kind}, {NOTES}"))
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return notes.drop("present").mapInArrow(_matcher(inverse_frequencies(notes)), schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
