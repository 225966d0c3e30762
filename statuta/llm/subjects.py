"""Subject areas of documents (problem 9): labelling functions joined by a model that learns their accuracy.

Texts are cut into sentences and words once and kept as numbers. A lexicon starts from the labelled
examples and the descriptions and grows on the sentences of all documents that it labels with
confidence. For each document and subject five labelling functions vote for, against or not at all:
the share of sentences by the grown lexicon, the share by the seed lexicon, the sections the subject
dominates, the address (what its docket's documents are about) and the source (what its kind of
document is about). A latent model learns each function's accuracy from the votes of all documents,
and subjects come from its posterior probabilities. Nothing depends on how the input is partitioned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.runs import sorted_runs
from statuta.runtime import cut, salt, spread

#: Labelled rows used for the seed; more are refused, so that what reaches the driver stays bounded.
MOST_EXAMPLES = 100_000
SHARE, POSTERIOR = 0.2, 0.5
#: A sentence is about the subject whose words weigh this much, and this much more than any other's.
LEAST, MARGIN = 1.8, 1.0
#: The same for the seed, whose words have been seen a few times only.
SEED_LEAST, SEED_MARGIN = 0.9, 0.5
#: A word of the grown lexicon is in this share of the labelled sentences (six at least), so there are no more
#: of them than sentences have words on average, divided by the share: below a million.
WORD_SHARE, WORD_LEAST = 2e-5, 6
#: Words below which a piece of text is no sentence (salutations, signatures, page marks), and below
#: which one without a full stop is none (dates, file numbers, headings).
LEAST_WORDS, LEAST_OPEN = 5, 9
VOTES = ("grown", "seed", "section", "address", "source")
WAYS = 8

TOKEN = re.compile(r"[^\W_]+")
PLAIN_TOKEN = re.compile(r"\w+")  # the same where there is no underscore, and faster
FULL_STOP = re.compile(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡(\"-])")
LINE = re.compile(r"\n\s*(?=\n|[-*•]|\(?[a-z0-9]{1,3}[.)]\s|[QA]:)")
BLANK_LINE = re.compile(r"\n\s*\n")
MARKUP = re.compile(r"</?(?:p|li|div|h\d|br|td|tr)\b[^>]*>")
BROKEN = re.compile(r"(?<=[a-zá-ú])-\n(?=[a-zá-ú])")

#: A sentence of at most so many words that stands in this share of the different texts (three at least,
#: copies of one text count once) is an office phrase if their subjects differ: there are so many of
#: them, and none has more than this share. There are no more phrases than a text has sentences on
#: average, divided by the share of texts.
PHRASE_WORDS, PHRASE_SHARE, PHRASE_TEXTS, PHRASE_SUBJECTS, PHRASE_TOP = 12, 0.0015, 3, 3, 0.8
#: Words of a batch beyond which it is handed on.
MOST_IN_BATCH = 2_000_000
_POWER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return (TOKEN if "_" in text else PLAIN_TOKEN).findall(text.lower())


def sentences(text: str) -> Iterator[tuple[int, list[str]]]:
    """(section number, words) of every sentence of at least ``LEAST_WORDS`` words."""
    if "-\n" in text:
        text = BROKEN.sub("", text)
    if "<" in text:
        text = MARKUP.sub("\n\n", text)
    for number, section in enumerate(BLANK_LINE.split(text)):
        for line in LINE.split(section) if "\n" in section else (section,):
            for sentence in FULL_STOP.split(line):
                found = words_of(sentence)
                if len(found) >= (LEAST_WORDS if sentence.rstrip()[-1:] in (".", "!", "?", ")") else LEAST_OPEN):
                    yield number, found


class WordIds(dict):
    """A whole number for a word, the same in every process: odd for those that no lexicon has (numbers, single letters)."""

    def __missing__(self, word: str) -> int:
        code = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        code = code | 1 if word.isdigit() or len(word) < 2 else code & ~1
        if len(self) >= 500_000:  # memory only
            self.clear()
        self[word] = code
        return code


@dataclass(frozen=True)
class Lexicon:
    """Words by their numbers, in order, each with the subject it stands for and its weight."""

    ids: np.ndarray
    subject: np.ndarray
    weight: np.ndarray


def lexicon_of(entries: dict[str, tuple[int, float]]) -> Lexicon:
    """A lexicon from words with subject and weight."""
    known = WordIds()
    rows = sorted((known[word], subject, weight) for word, (subject, weight) in entries.items())
    return Lexicon(*(np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, np.int64, float))))


def labels(ids: np.ndarray, owner: np.ndarray, n: int, lexicon: Lexicon, size: int, least: float = LEAST, margin: float = MARGIN) -> np.ndarray:
    """The subject of each of ``n`` sentences, or -1; owner is each word's sentence, in order. Repeated words count once."""
    found = np.full(n, -1)
    if not len(lexicon.ids):
        return found
    step = max(1, 4_000_000 // size)
    for lo in range(0, n, step):
        a, b = np.searchsorted(owner, [lo, lo + step])
        rows = min(step, n - lo)
        at = np.minimum(np.searchsorted(lexicon.ids, ids[a:b]), len(lexicon.ids) - 1)
        hit = lexicon.ids[at] == ids[a:b]
        sentence, word = np.divmod(np.unique((owner[a:b][hit] - lo) * len(lexicon.ids) + at[hit]), len(lexicon.ids))
        scores = np.bincount(sentence * size + lexicon.subject[word], lexicon.weight[word], rows * size).reshape(rows, size)
        best = scores.argmax(1)
        top = scores[np.arange(rows), best]
        scores[np.arange(rows), best] = 0
        found[lo : lo + rows] = np.where((top >= least) & (top - scores.max(1) >= margin), best, -1)
    return found


def weigh(counts: np.ndarray, totals: np.ndarray, least: float, purity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, subject, weight) of the words (rows of counts by subject) that stand for one subject.

    The weight is the log odds of that subject against the others.
    """
    size = len(totals)
    rates = counts / np.maximum(1.0, totals) * totals.sum() / max(1, size)
    total, subject, best = rates.sum(1), rates.argmax(1), rates.max(1)
    share = (best + 0.2) / (total + 0.2 * size)
    at = np.flatnonzero((counts.sum(1) >= least) & (best >= purity * total) & (share > 1.5 / size))
    with np.errstate(divide="ignore"):
        weight = np.round(np.minimum(3.0, np.log(share[at] / (1 - share[at]) * (size - 1)) / 1.5), 3)
    return at, subject[at], weight


def seed_lexicon(examples: DataFrame, subjects: DataFrame) -> tuple[list[str], Lexicon]:
    """Subject names in order and the lexicon of their examples and descriptions.

    Rows with null text or subject, and subjects that are not in ``subjects``, are left out.
    """
    names = sorted(r[0] for r in subjects.where("subject is not null").select("subject").distinct().collect())
    number = {name: i for i, name in enumerate(names)}
    rows = examples.where("text is not null and subject is not null").select("subject", "text").limit(MOST_EXAMPLES + 1).collect()
    if len(rows) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} labelled rows; fit on a sample of that size")
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(names)))
    totals = np.zeros(len(names))
    for subject, text in rows:
        if subject in number:
            totals[number[subject]] += 1
            for word in set(TOKEN.findall(text.lower())):
                counts[word][number[subject]] += 1
    for subject, text in subjects.where("subject is not null and description is not null").select("subject", "description").collect():
        for word in set(TOKEN.findall(text.lower())):
            if len(word) > 4:
                counts[word][number[subject]] += 1
    plain = [w for w in counts if not w.isdigit() and len(w) > 1]
    if not plain:
        return names, lexicon_of({})
    at, subject, weight = weigh(np.stack([counts[w] for w in plain]), totals, 2, 0.75)
    return names, lexicon_of({plain[i]: (int(s), float(w)) for i, s, w in zip(at, subject, weight)})


def marks(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for every sentence, from its words in order; sizes are at least 1."""
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _POWER, np.uint64))
    return np.add.reduceat(ids.view(np.uint64) * powers[np.arange(len(ids)) - np.repeat(starts, sizes)], starts).view(np.int64) if len(sizes) else np.zeros(0, np.int64)


def mark_of(words: list[str]) -> int:
    known = WordIds()
    return int(marks(np.array([known[w] for w in words], np.int64), np.array([len(words)]))[0])


def _lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def tokenized(documents: DataFrame) -> DataFrame:
    """(doc_id, docket_id, source, text_no, parts, sizes, ids): per document the section and size of its sentences, and their words.

    text_no is the same for equal texts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            first, numbers, lengths, counts, parts, sizes, ids = 0, [], [], [], [], [], []

            def handed(end: int) -> pa.RecordBatch:
                rows = batch.slice(first, end - first)
                return pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("doc_id", "docket_id", "source")), pa.array(numbers, pa.int64()), _lists(np.array(parts, np.int32), counts), _lists(np.array(sizes, np.int32), counts), _lists(np.array(ids, np.int64), lengths)],
                    ["doc_id", "docket_id", "source", "text_no", "parts", "sizes", "ids"],
                )

            for at, text in enumerate(batch.column("text")):
                text, before, words = text.as_py(), len(parts), len(ids)
                for part, found in sentences(text):
                    parts.append(part)
                    sizes.append(len(found))
                    ids += [known[w] for w in found]
                numbers.append(int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                counts.append(len(parts) - before)
                lengths.append(len(ids) - words)
                if len(ids) > MOST_IN_BATCH:
                    yield handed(at + 1)
                    first, numbers, lengths, counts, parts, sizes, ids = at + 1, [], [], [], [], [], []
            if numbers:
                yield handed(batch.num_rows)

    return documents.select("doc_id", "text", "docket_id", "source").mapInArrow(read, "doc_id long, docket_id string, source string, text_no long, parts array<int>, sizes array<int>, ids array<long>")


class _Batch:
    """Sentences of a batch of tokenized documents: doc of each, and the words of all with their sentence."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        self.ids, self.sizes = flat("ids"), flat("sizes").astype(np.int64)
        self.doc = np.repeat(np.arange(batch.num_rows), batch.column("sizes").value_lengths().to_numpy(zero_copy_only=False))
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.marks = marks(self.ids, self.sizes)

    def mains(self, found: np.ndarray, docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the subject of most labelled sentences (-1 without any), and whether it is a clear one."""
        known = found >= 0
        votes = np.bincount(self.doc[known] * size + found[known], minlength=docs * size).reshape(docs, size)
        most = votes.max(1)
        return np.where(most > 0, votes.argmax(1), -1), (most >= 3) & (most >= 0.7 * votes.sum(1))


def grow(tokens: DataFrame, seed: Lexicon, size: int) -> tuple[Lexicon, np.ndarray]:
    """The lexicon of the words in all sentences that the seed labels, and the marks of the office phrases.

    Where most labelled sentences of a document (three at least) share a subject, its unlabelled ones
    count for it too; that brings in the words of languages with few examples. A sentence that
    recurs word for word counts once for a subject, so set phrases gain no weight: its occurrences
    meet by their mark, one of each task.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(seed)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            x = _Batch(batch)
            found = labels(x.ids, x.owner, len(x.sizes), shared.value, size, SEED_LEAST, SEED_MARGIN)
            main, clear = x.mains(found, batch.num_rows, size)
            found = np.where(found >= 0, found, np.where(clear, main, -1)[x.doc])
            with np.errstate(over="ignore"):
                key = x.marks ^ (found + 1) * np.int64(0x2545F4914F6CDD1D)
            first = np.unique(key, return_index=True)[1]
            first = np.sort(first[(found[first] >= 0) & ~np.isin(key[first], seen)])
            seen = np.union1d(seen, key[first])
            kept = np.zeros(len(x.sizes), bool)
            kept[first] = True
            use = kept[x.owner] & (x.ids & 1 == 0)
            order = np.lexsort((x.ids[use], x.owner[use]))
            word, owner = x.ids[use][order], x.owner[use][order]
            new = np.r_[True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])][: len(word)]
            word, lengths = word[new], np.bincount(owner[new], minlength=len(x.sizes))[first]
            words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths * 8)].astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(word).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(x.marks[first]), pa.array(found[first], pa.int32()), words], ["mark", "subject", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1], pa.int32()), pa.array(n)], ["word", "subject", "n"])
        for table in sorted_runs(batches, "mark"):
            mark, subject = table.column("mark").to_numpy(), table.column("subject").to_numpy().astype(np.int64)
            order = np.lexsort((subject, mark))
            first = order[np.r_[True, (mark[order][1:] != mark[order][:-1]) | (subject[order][1:] != subject[order][:-1])]]
            words = table.column("words").take(pa.array(first)).to_pylist()
            flat = np.frombuffer(b"".join(words), np.int64)
            owner = np.repeat(subject[first], [len(w) // 8 for w in words])
            # -1 stands for the sentence itself: no lexicon has an odd number.
            new = np.stack([np.r_[flat, np.full(len(first), -1)], np.r_[owner, subject[first]]], 1)
            every, times = np.concatenate([pairs, new]), np.r_[n, np.ones(len(new), np.int64)]
            order = np.lexsort((every[:, 1], every[:, 0]))
            every, times = every[order], times[order]
            starts = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]).any(1)])
            pairs, n = every[starts], np.add.reduceat(times, starts)
            if len(n) > 1_000_000:
                yield handed()
                pairs, n = pairs[:0], n[:0]
        yield handed()

    sentences_ = tokens.select("sizes", "ids").mapInArrow(labelled, "mark long, subject int, words binary").repartition("mark").sortWithinPartitions("mark")
    counted = cut(sentences_.mapInArrow(count, "word long, subject int, n long").groupBy("word", "subject").agg(F.sum("n").alias("n")), "lexicon")
    totals = np.zeros(size)
    for row in counted.where("word = -1").collect():  # one row per subject
        totals[row["subject"]] = row["n"]
    by = [F.coalesce(F.sum(F.when(F.col("subject") == i, F.col("n"))), F.lit(0)).alias(f"s{i}") for i in range(size)]
    least = max(WORD_LEAST, totals.sum() * WORD_SHARE)
    words = counted.where("word <> -1").groupBy("word").agg(F.sum("n").alias("all"), *by).where(F.col("all") >= least).drop("all").toPandas().sort_values("word")
    at, subject, weight = weigh(words[[f"s{i}" for i in range(size)]].to_numpy(float), totals, least, 0.6)
    grown = Lexicon(words["word"].to_numpy(np.int64)[at], subject, weight)
    return grown if len(grown.ids) else seed, office_phrases(tokens, seed, size)


def office_phrases(tokens: DataFrame, seed: Lexicon, size: int) -> np.ndarray:
    """Marks, in order, of the short sentences of many different texts with different subjects (see ``PHRASE_SHARE``)."""
    shared = tokens.sparkSession.sparkContext.broadcast(seed)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _Batch(batch)
            main, _ = x.mains(labels(x.ids, x.owner, len(x.sizes), shared.value, size, SEED_LEAST, SEED_MARGIN), batch.num_rows, size)
            at = np.flatnonzero(x.sizes <= PHRASE_WORDS)
            text = batch.column("text_no").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x.marks[at]), pa.array(text[x.doc[at]]), pa.array(main[x.doc[at]], pa.int32())], ["mark", "text", "main"])

    different = tokens.select("text_no").distinct().count()
    known = F.when(F.col("main") >= 0, F.col("n"))
    texts = tokens.select("text_no", "sizes", "ids").mapInArrow(short, "mark long, text long, main int").groupBy("mark", "text").agg(F.max("main").alias("main"))
    common = texts.groupBy("mark", "main").agg(F.count("*").alias("n")).groupBy("mark").agg(F.sum("n").alias("texts"), F.count(known).alias("subjects"), F.max(known).alias("top"), F.sum(known).alias("known"))
    common = common.where((F.col("texts") >= max(PHRASE_TEXTS, PHRASE_SHARE * different)) & (F.col("subjects") >= min(PHRASE_SUBJECTS, size)) & (F.col("top") <= PHRASE_TOP * F.col("known")))
    return np.array(sorted(r["mark"] for r in common.select("mark").collect()), np.int64)


def shares(tokens: DataFrame, seed: Lexicon, grown: Lexicon, office: np.ndarray, size: int) -> DataFrame:
    """(doc_id, docket_id, source, subject_no, n_sentences, grown, seed, section) for every subject that any sentence is about.

    grown is a share of all sentences but office phrases, seed of those that the seed labels; section
    is the share of sections the subject dominates.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((seed, grown, office))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, phrases = shared.value
        for batch in batches:
            x, docs = _Batch(batch), batch.num_rows
            kept = ~((x.sizes <= PHRASE_WORDS) & np.isin(x.marks, phrases))
            by_seed, by_grown = (labels(x.ids, x.owner, len(x.sizes), *z) for z in ((first, size, SEED_LEAST, SEED_MARGIN), (second, size)))
            doc, by_seed, by_grown = x.doc[kept], by_seed[kept], by_grown[kept]
            part = batch.column("parts").flatten().to_numpy(zero_copy_only=False)[kept]
            count = lambda at, of: np.bincount(at[of >= 0] * size + of[of >= 0], minlength=docs * size).reshape(docs, size)
            seeds, growns, n = count(doc, by_seed), count(doc, by_grown), np.bincount(doc, minlength=docs)
            starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])][: len(doc)])
            section = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(doc)]))
            key, times = np.unique(section * (size + 1) + by_grown + 1, return_counts=True)
            section_of, of = key // (size + 1), key % (size + 1) - 1
            leading = (of >= 0) & (2 * times >= np.bincount(section, minlength=len(starts))[section_of])
            led = count(doc[starts][section_of[leading]], of[leading])
            parts, labelled = np.bincount(doc[starts], minlength=docs), seeds.sum(1)
            d, s = np.nonzero(seeds + growns)
            columns = [pa.array(s, pa.int32()), pa.array(n[d]), pa.array(growns[d, s] / n[d]), pa.array(seeds[d, s] / np.maximum(1, labelled[d])), pa.array(led[d, s] / parts[d])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(d)) for c in ("doc_id", "docket_id", "source")), *columns], ["doc_id", "docket_id", "source", "subject_no", "n_sentences", "grown", "seed", "section"])

    return tokens.select("doc_id", "docket_id", "source", "parts", "sizes", "ids").mapInArrow(measure, "doc_id long, docket_id string, source string, subject_no int, n_sentences long, grown double, seed double, section double")


def learn(patterns: pd.DataFrame, subjects: int, rounds: int = 60) -> pd.DataFrame:
    """Posterior of each vote pattern (columns of VOTES with 1, 0 or -1 for abstaining, subject_no, n).

    Two-class latent model fitted by expectation and maximisation on counts: a prior per subject and
    for each function how often it votes for, against or not at all in either class. It starts from
    the vote of the first function.
    """
    votes = patterns[list(VOTES)].to_numpy(int) + 1
    n, subject = patterns["n"].to_numpy(float), patterns["subject_no"].to_numpy(int)
    posterior = np.where(votes[:, 0] == 2, 0.9, 0.02)
    for _ in range(rounds):
        on = np.bincount(subject, n * posterior, subjects)
        prior = (on + 1) / (np.bincount(subject, n, subjects) + 2)
        logit = np.log(prior / (1 - prior))[subject]
        for j in range(votes.shape[1]):
            yes = np.bincount(votes[:, j], n * posterior, 3) + 0.5
            no = np.bincount(votes[:, j], n * (1 - posterior), 3) + 0.5
            logit = logit + np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
        posterior = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return patterns.assign(posterior=posterior)


def subject_areas(documents: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share, posterior) of every subject that some sentence of a document is about.

    Null, blank and wordless texts, and documents about none, have no rows. A null docket or source
    lets the labelling function abstain. Texts are read whole; other columns are ignored; doc_id is
    taken to be unique.
    """
    spark = documents.sparkSession
    names, seed = seed_lexicon(examples, subjects)
    schema = "doc_id long, subject string, share double, posterior double"
    if not names:
        return spark.createDataFrame([], schema)
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "docket_id", "source")
    tokens = cut(tokenized(spread(rows, "doc_id")), "tokens")
    grown, office = grow(tokens, seed, len(names))
    known = cut(shares(tokens, seed, grown, office, len(names)), "shares")
    place = tokens.select("doc_id", "docket_id", "source")
    hits = known.where(F.col("grown") >= SHARE)
    ways = F.explode(F.array(*[F.lit(i) for i in range(WAYS)]))
    dockets = hits.groupBy("docket_id", "subject_no").agg(F.count("*").alias("hits")).join(place.groupBy("docket_id").agg(F.count("*").alias("docs")), "docket_id")
    kinds = place.where("source is not null").groupBy("source").agg(F.count("*").alias("n")).withColumn("subject_no", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    of_kind = hits.where("source is not null").groupBy("source", "subject_no").agg(F.count("*").alias("k"))
    hit, placed = {r["subject_no"]: r["k"] for r in of_kind.groupBy("subject_no").agg(F.sum("k").alias("k")).collect()}, place.where("source is not null").count()  # a row per subject
    usual = F.get(F.array(*[F.lit((hit.get(i, 0) + 1) / (placed + len(names))) for i in range(len(names))]), F.col("subject_no"))
    lifts = kinds.join(of_kind, ["source", "subject_no"], "left").select("source", "subject_no", ((F.coalesce("k", F.lit(0)) + 1) / (F.col("n") + len(names)) / usual).alias("lift"))
    # A docket or a source may hold a third of all documents: its rows are spread, its statistics repeated.
    voted = known.withColumn("_way", salt("doc_id", WAYS)).join(dockets.withColumn("_way", ways), ["docket_id", "subject_no", "_way"], "left").join(lifts.withColumn("_way", ways), ["source", "subject_no", "_way"], "left")
    others = F.col("docs") - 1  # of the docket, without the document itself
    own = (F.col("grown") >= SHARE).cast("int")
    rate = (F.coalesce("hits", F.lit(0)) - own) / F.nullif(others, F.lit(0))
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    voted = voted.select(
        "doc_id", "subject_no", F.col("grown").alias("share"),
        vote(F.col("grown") >= SHARE, F.col("grown") < SHARE).alias("grown"),
        vote(F.col("seed") >= SHARE, F.col("seed") < SHARE).alias("seed"),
        vote(F.col("section") >= SHARE, F.col("section") < SHARE).alias("section"),
        vote((others > 0) & (rate >= 0.5), (others > 0) & (rate < 0.05)).alias("address"),
        vote(F.col("lift") >= 1.5, F.col("lift") < 0.5).alias("source"),
    )
    voted = cut(voted, "voted")
    patterns = voted.groupBy("subject_no", *VOTES).agg(F.count("*").alias("n")).toPandas()  # at most 3^5 a subject
    docs = place.count()
    silent = pd.DataFrame([{"subject_no": i, "grown": 0, "seed": 0, "section": 0, "address": -1, "source": -1, "n": docs - int(patterns.loc[patterns["subject_no"] == i, "n"].sum())} for i in range(len(names))])
    patterns = pd.concat([patterns, silent]).groupby(["subject_no", *VOTES], as_index=False)["n"].sum()
    learned = learn(patterns, len(names))
    learned["subject"] = [names[i] for i in learned["subject_no"]]
    table = spark.createDataFrame(learned[["subject_no", *VOTES, "posterior", "subject"]])
    return voted.join(F.broadcast(table), ["subject_no", *VOTES]).select("doc_id", "subject", "share", "posterior")


def composition(areas: DataFrame, n_documents: int) -> DataFrame:
    """(subject, n_docs, corpus_share) of documents assigned to each subject."""
    return areas.where(F.col("posterior") >= POSTERIOR).groupBy("subject").agg(F.count("*").alias("n_docs")).withColumn("corpus_share", F.col("n_docs") / F.lit(max(1, n_documents)))
