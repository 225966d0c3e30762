from __future__ import annotations

import random

import numpy as np
import pandas as pd

from statuta.llm import leaks, subjects

ITEMS = "item_id long, passage string, question string, answer string"
DOCS = "doc_id long, text string, lang string, source string, docket_id string, subject string, item_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, k, "x", 1) for i, t, s, k in rows], DOCS)


def test_leaks_equal_brute_force(spark):
    choose = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so runs collide
    passages = [" ".join(choose.choices(vocabulary, k=choose.choice([5, 11, 12, 13, 30, 60]))) for _ in range(25)]
    texts = []
    for _ in range(120):
        text = choose.choices(vocabulary, k=choose.randint(0, 50))
        for _ in range(choose.randint(0, 3)):
            p = choose.choice(passages).split()
            a = choose.randrange(len(p))
            text[len(text) // 2 : len(text) // 2] = p[a : a + choose.randint(1, 25)]
        texts.append("".join(w.upper() + choose.choice([" ", "\n", ", ", " - ", "_"]) for w in text))
    items = spark.createDataFrame([(i, p, None, None) for i, p in enumerate(passages)] + [(99, passages[0], None, None), (98, None, None, None), (None, passages[1], None, None)], ITEMS)
    spans = leaks.find_leaks(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(1000, None, None, None), (1001, "", None, None), (None, texts[0], None, None)]), items).collect()
    grams = lambda words: {tuple(words[k : k + 12]) for k in range(len(words) - 11)}
    words = lambda t: leaks.WORD.findall(t.lower())
    truth = {(d, i) for d, t in enumerate(texts) for i, p in [*enumerate(passages), (99, passages[0])] if grams(words(t)) & grams(p.split())}
    assert {(r.doc_id, r.item_id) for r in spans} == truth and truth
    for r in spans:
        found = words(texts[r.doc_id][r.start_char : r.end_char])
        assert len(found) >= 12 and " ".join(found) in " ".join(passages[0 if r.item_id == 99 else r.item_id].split())


def test_offsets_questions_and_odd_letters(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    text = "İİ ß § " + "x " * 200_000 + "One, two\n\nthree four five six SEVEN eight nine ten eleven twelve: thirteen fourteen"
    items = spark.createDataFrame([(1, "short", passage, None)], ITEMS)
    found = leaks.find_leaks(docs(spark, [(1, text, None, None)]), items, ("passage", "question", "answer")).collect()
    assert [(r.item_id, r.field) for r in found] == [(1, "question")]
    assert text[found[0].start_char : found[0].end_char].startswith("One, two") and text[: found[0].end_char].endswith("thirteen")
    gap = passage.replace("six", "six and")
    assert leaks.find_leaks(docs(spark, [(1, gap, None, None)]), items, ("question",)).count() == 0
    assert leaks.find_leaks(docs(spark, []), items).count() == 0 and leaks.find_leaks(docs(spark, [(1, text, None, None)]), items.limit(0)).count() == 0


def test_short_questions_and_answers_count_whole(spark):
    items = spark.createDataFrame([(1, "p " * 12, "what is the fat of milk", "At least 3 %"), (2, None, "", "...")], ITEMS)
    texts = ["He asked: What is the FAT of milk? At least (3) percent.", "what is the fat of", "what is the fat of soy milk; at most 3", "at least 3 at least 3"]
    rows = docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = sorted((r.doc_id, r.field, texts[r.doc_id][r.start_char : r.end_char]) for r in leaks.find_leaks(rows, items, ("passage", "question", "answer"), short=True).collect())
    assert found == [(0, "answer", "At least (3"), (0, "question", "What is the FAT of milk"), (3, "answer", "at least 3"), (3, "answer", "at least 3")]
    assert leaks.find_leaks(rows, items, ("passage", "question", "answer")).count() == 0


def test_blocks_of_evaluation_texts_find_the_same(spark, monkeypatch):
    choose = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(choose.choices("abcdefgh", k=30)), None, None) for i in range(12)] + [(99, None, None, None)], ITEMS)
    passages = [r.passage for r in items.where("passage is not null").collect()]
    rows = docs(spark, [(i, f"x {p[4:40]} y {choose.choice(passages)}", None, None) for i, p in enumerate(passages)])
    got = lambda: sorted(map(tuple, leaks.find_leaks(rows, items).collect()))
    one = got()
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 100)
    assert got() == one and len(one) >= 12
    assert leaks.find_leaks(rows, items.limit(0)).count() == 0


SUBJECTS = {s: [f"{s}{i}" for i in range(40)] for s in ("law", "farm", "code", "tax")}
GENERIC = [f"plain{i}" for i in range(60)]


def sentence(choose, subject, foreign=None):
    nouns = choose.choices(SUBJECTS[subject], k=4) if subject else []
    nouns += choose.choices(SUBJECTS[foreign], k=1) if foreign else []
    text = nouns + choose.choices(GENERIC, k=8)
    choose.shuffle(text)
    return " ".join(text).capitalize() + "."


def made(seed, n):
    choose, rows, truth = random.Random(seed), [], set()
    for i in range(n):
        main, second = choose.sample(list(SUBJECTS), 2)
        share = choose.choice([0, 0.05, 0.35, 0.5])
        plan = [None] * 12 if i % 10 == 0 else [second if k < share * 20 else main for k in range(20)]
        text = " ".join(sentence(choose, s, choose.choice([None, None, *SUBJECTS]) if s else None) for s in plan)
        truth |= {(i, s) for s in set(plan) - {None} if plan.count(s) >= len(plan) / 5}
        rows.append((i, text, choose.choice(["memo", "letter", None]), choose.choice(["hot", f"d{i}", None])))
    return rows, truth


def test_held_out_accuracy(spark):
    choose = random.Random(8)
    examples = [(i, " ".join(sentence(choose, s) for _ in range(3)), s, "x") for i, s in enumerate(list(SUBJECTS) * 8)] + [(900, None, "law", "x"), (901, "text", None, "x"), (902, "text", "unknown", "x")]
    labelled = spark.createDataFrame(examples, "example_id long, text string, subject string, doc_id string")
    names = spark.createDataFrame([(s, f"About {s}") for s in SUBJECTS] + [(None, "none")], "subject string, description string")
    rows, truth = made(9, 300)
    extra = [(1000, None, None, None), (1001, " \n ", None, "hot"), (1002, "... !", "memo", None), (1003, sentence(choose, "law") + " Word" * 100_000, None, None)]
    areas = subjects.subject_areas(docs(spark, rows + extra), labelled, names)
    got = {(r.doc_id, r.subject) for r in areas.where(f"posterior >= {subjects.POSTERIOR}").collect() if r.doc_id < 1000}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97
    shares = {r.subject: r.corpus_share for r in subjects.composition(areas, 304).collect()}
    assert set(shares) == set(SUBJECTS) and all(0.2 < s < 0.6 for s in shares.values())
    assert subjects.subject_areas(docs(spark, []), labelled, names).count() == 0
    assert subjects.subject_areas(docs(spark, rows[:5]), labelled.limit(0), names.limit(0)).count() == 0


def test_office_phrases_are_shares_of_the_texts_whatever_their_subject(spark):
    choose, seed = random.Random(12), subjects.lexicon_of({w: (s, 1.0) for s, words in enumerate(SUBJECTS.values()) for w in words})
    names, office, local = list(SUBJECTS), "Please quote the number in replies.", "Every farm1 is kept by farm2 alone."
    for n in (400, 8_000):
        rows = []
        for i in range(n):
            subject = names[i % 4]
            text = " ".join(sentence(choose, subject) for _ in range(4))
            rows.append((i, f"{text} {office}" if i % 100 in (0, 1, 2, 3) else f"{text} {local}" if subject == "farm" and i % 20 == 5 else text, None, None))
        rows += [(n + i, sentence(random.Random(1), "law") + " A copied text is one text only.", None, None) for i in range(n // 50)]
        found = subjects.office_phrases(subjects.tokenized(docs(spark, rows)), seed, 4)
        assert found.tolist() == [subjects.mark_of(subjects.words_of(office))]


def test_accuracies_are_learned():
    """A labelling function that votes at random must not outweigh two that agree."""
    choose, rows = random.Random(10), []
    for _ in range(4000):
        y = choose.random() < 0.3
        rows.append((0, *(int(y if choose.random() < p else not y) for p in (0.95, 0.9, 0.9, 0.5)), -1))
    patterns = pd.DataFrame(rows, columns=["subject_no", *subjects.VOTES]).value_counts().rename("n").reset_index()
    learned = subjects.learn(patterns, 1).set_index(list(subjects.VOTES))["posterior"]
    assert learned[1, 1, 1, 0, -1] > 0.95 and learned[0, 0, 0, 1, -1] < 0.05 and learned[1, 0, 0, 1, -1] < 0.5


def test_office_phrases_and_sentences():
    text = "Dear all,\n\nApril 3, 2020\n\n- This item is about a long-\nwinded matter of law.\n<p>Second sentence has (five) words.</p> Third no. 12 sentence is not split here.\n\nSincerely,\nThe Office"
    found = [" ".join(w) for _, w in subjects.sentences(text)]
    assert found == ["this item is about a longwinded matter of law", "second sentence has five words", "third no 12 sentence is not split here"]
    assert subjects.mark_of(["thank", "you"]) == subjects.mark_of(["thank", "you"]) != subjects.mark_of(["you", "thank"])
    ids = subjects.WordIds()
    assert ids["12"] % 2 == ids["x"] % 2 == 1 and ids["law"] % 2 == 0


def test_labels_count_repeated_words_once():
    table, ids = subjects.lexicon_of({"a1": (0, 1.0), "b1": (1, 1.0), "b2": (1, 1.0)}), subjects.WordIds()
    found = [["a1", "a1", "zz"], ["b1", "b2", "a1"], ["zz"], ["a1", "b1"]]
    flat, owner = np.array([ids[w] for x in found for w in x]), np.repeat(np.arange(4), [len(x) for x in found])
    assert subjects.labels(flat, owner, 4, table, 2, 1.5, 1.0).tolist() == [-1, 1, -1, -1]
    assert subjects.labels(flat, owner, 4, table, 2, 1.0, 0.5).tolist() == [0, 1, -1, -1] and subjects.labels(flat, owner, 4, subjects.lexicon_of({}), 2).tolist() == [-1] * 4


def test_partitions_do_not_matter(spark, monkeypatch):
    choose = random.Random(8)
    labelled = spark.createDataFrame([(i, " ".join(sentence(choose, s) for _ in range(3)), s) for i, s in enumerate(list(SUBJECTS) * 8)], "example_id long, text string, subject string")
    names = spark.createDataFrame([(s, f"About {s}") for s in SUBJECTS], "subject string, description string")
    rows, _ = made(11, 120)
    rows += [(500 + i, rows[i % 7][1], None, None) for i in range(40)]  # sentences that recur in many tasks
    monkeypatch.setattr(subjects, "spread", lambda df, key: df)
    got = []
    for n, batch in ((1, 2_000_000), (4, 500), (16, 50)):
        monkeypatch.setattr(subjects, "MOST_IN_BATCH", batch)
        got.append(sorted(map(tuple, subjects.subject_areas(docs(spark, rows).repartition(n), labelled, names).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) > 100
