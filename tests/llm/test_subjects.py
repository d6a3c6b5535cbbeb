import random

import pyarrow as pa

from yieldloom.llm import subjects

AREAS = [("plants", "Trees, roots and leaves"), ("music", "Violin, concert, choir"), ("money", "Bank, loan and interest")]
WORDS = {"plants": "tree root leaf branch moss seed".split(), "music": "violin concert choir tenor flute opera".split(), "money": "bank loan interest rate bond share".split()}
FILLER = ["See the note from monday.", "Nothing else was said today.", "Thanks to all who came."]


def text(rnd, subject, n):
    parts = []
    for _ in range(n):
        a, b = rnd.sample(WORDS[subject], 2)
        parts.append(rnd.choice([f"We looked at the {a} and the {b} again.", f"Is the {a} like the {b}?", f"The {a} was near the {b}.\n"]))
        if rnd.random() < 0.4:
            parts.append(rnd.choice(FILLER))
    return parts


def corpus(n=400, seed=0):
    rnd, docs, truth = random.Random(seed), [], set()
    for i in range(n):
        own = rnd.sample(list(WORDS), rnd.choice([0, 1, 1, 2]))
        parts = sum((text(rnd, s, rnd.randint(3, 6)) for s in own), []) or FILLER[:2]
        rnd.shuffle(parts)
        docs.append((i, " ".join(parts)))
        truth |= {(i, s) for s in own}
    return docs, truth


def run(spark, docs, labels, **config):
    c = subjects.SubjectConfig(**{"min_share": 0.0, "general_topics": 3, **config})
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc long, text string, terms string")
    a = spark.createDataFrame(AREAS, "subject string, description string")
    encoded, topics = subjects.prepare(d, "doc", "text", spark.createDataFrame(labels, "id long, subject string"), a, c)
    return {(r.id, r.subject) for r in subjects.document_subjects(encoded, topics, c).collect()}, topics


def test_held_out_subjects(spark):
    docs, truth = corpus()
    labels = [x for x in truth if x[0] % 4 == 0]
    labels += labels[:5] + [(1, "unknown"), (999_999, "music"), (None, "music"), (2, None)]
    got, topics = run(spark, docs, labels)
    held = lambda s: {x for x in s if x[0] % 4}
    both = len(held(got) & held(truth))
    assert both / len(held(got)) > 0.95 and both / len(held(truth)) > 0.95
    assert {topics.subjects[s] for s in topics.subject_of if s >= 0} == set(WORDS)


def test_texts_without_content_and_equal_texts(spark):
    docs, truth = corpus(100)
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, docs[0][1]), (1004, "12 34 5.6"), (1005, " ".join(text(random.Random(1), "music", 3_000)))]
    got, _ = run(spark, docs + odd, list(truth))
    of = lambda i: {s for d, s in got if d == i}
    assert not any(of(i) for i in (1000, 1001, 1002, 1004)) and of(1003) == of(0) and of(1005) == {"music"}


def test_empty_tables(spark):
    assert run(spark, [], [])[0] == set()
    got, _ = run(spark, corpus(60)[0], [])  # descriptions alone
    assert isinstance(got, set)


def cut_words(*texts):
    cutter = subjects.Cutter()
    word, row = cutter.cut(pa.array(texts, pa.string()))
    names = list(cutter.number)
    return [[names[w] for w in word[row == i]] for i in range(len(texts))]


def test_markup_capitals_digits_and_codes_are_undone():
    for got in cut_words("The pump.\nClean room", "<p>THE PUMP.<br/>&nbsp;Clean room</p>", "the pump 3.5 CVD-41. c1ean r00m 17", "The pump\nW02 clean room 17.", "the pump! clean_room"):
        assert [w for w in got if w != "."] == ["the", "pump", "clean", "room"], got
        assert got.index("clean") - got.index("pump") > 1, got  # an end of sentence lies between
    assert cut_words("a 1", None, "", " ", "over-etch") == [[], [], [], [], ["over", "etch"]]


def test_only_wrongly_decoded_letters_are_changed():
    assert cut_words("GeprÃ¼ft", "NÃO: Die Prüfung der Ätzanlage wurde geprÃ¼ft", "Il a dâ€™abord Ã©tÃ©") == [
        ["geprüft"], ["não", "die", "prüfung", "der", "ätzanlage", "wurde", "geprüft"], ["il", "abord", "été"]]
