import random
import re
import string
from collections import Counter

import numpy as np

from weftgraph.operators import vectors
from weftgraph.plans.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, rows):
    """`rows` of (doc_id, text, lang) as the documents table of a folder."""
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_question_entities_of_the_whole_text(spark, tmp_path):
    names = [f"Name{chr(65 + i)}" for i in range(20)]
    text = " met and then for a long while talked with ".join(names)
    got = QUERIES["q67_question_entities"](spark, documents(spark, tmp_path, [(1, text, "en"), (2, None, "en"), (3, "nobody", "en")])).collect()
    assert {r.graph_id: r.entities for r in got} == {1: "\n".join(names), 2: "", 3: ""}


def evidence(text):
    """By brute force: the eight sentences nearest to the whole text, at their first place."""
    sentences = list(dict.fromkeys(s.strip() for s in text.split(". ") if s.strip()))
    sims = vectors.hashing_encoder(sentences).astype(float) @ vectors.hashing_encoder([text])[0].astype(float)
    order = sorted(range(len(sentences)), key=lambda i: (-sims[i], i))[:8]
    return [(sentences[i], sims[i]) for i in order if sims[i] >= 0]


def test_evidence_for_the_whole_text(spark, tmp_path):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))
    start = ". ".join(f"{word('xyz')} opening {word('xyz')}" for _ in range(9))
    text = start + ". " + ". ".join(" ".join(["harbour of the town", *(word("abcdefghij") for _ in range(6))]) for _ in range(12))
    got = QUERIES["q26_text_rag_topk"](spark, documents(spark, tmp_path, [(1, text, "en")])).orderBy("rank").collect()
    want = evidence(text)
    assert [r.sentence for r in got] == [s for s, _ in want] and np.allclose([r.sim for r in got], [x for _, x in want], atol=1e-5)


def test_documents_of_every_language(spark, tmp_path):
    rows = [
        (1, "The harbour is old. A new harbour came.", "en"), (2, "Der Hafen ist alt. Ein neuer Hafen kam.", "de"),
        (3, "zwei Straße. Die Straßen sind lang", "de"), (4, "uno dos. tres", "es"), (5, "le port", None), (6, None, "fr"), (7, "say yes. yes", "fr"),
    ]
    sf = documents(spark, tmp_path, rows)

    def found(text):
        m = re.search(r"[A-Za-z]+ ([A-Za-z]+)", text or "")
        needle = m[1].lower() if m else ""
        return needle not in ("", "yes", "no") and any(re.search(rf"\b{needle}\b", s.lower()) for s in text.split(". "))

    got = {r.doc_id: r.grounded for r in QUERIES["q06_text_grounding"](spark, sf).collect()}
    assert got == {i: found(text) for i, text, _ in rows}
    assert not got[3] and got[2]  # "Stra" isn't a word of its own
    near = {r.graph_id for r in QUERIES["q26_text_rag_topk"](spark, sf).collect()}
    assert near == {1, 2, 3, 4, 5, 7}


def test_answers_are_whole_turns(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(15))
    turns = [
        (1, 1, same + " one"), (1, 2, same + " two"), (1, 3, "Él está aquí " * 6 + "mañana"), (1, 4, "el esta aqui"),
        (2, 1, "caf"), (2, 2, "café"), (2, 3, "the a an"), (2, 4, "!"), (3, 1, None), (3, 2, "x y x"), (3, 4, "x x z"),
    ]
    spark.createDataFrame([(c, n, "user", t) for c, n, t in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def tokens(text):
        bare = "".join(c for c in text.lower() if c not in string.punctuation)
        return [w for w in bare.split() if w not in ("a", "an", "the")]

    want = {}
    for (c, n, gold), (d, _, after) in zip(turns, turns[1:], strict=False):
        if c == d and gold is not None:
            p, g = tokens("The " + gold.upper() + "!" if n % 3 == 0 else after), tokens(gold)
            shared = sum((Counter(p) & Counter(g)).values())
            want[c, n] = (float(p == g), 2 * shared / (len(p) + len(g)) if p and g else float(len(p) == len(g)))
    got = {(r.conv_id, r.turn): (r.em, r.f1) for r in QUERIES["q40_em_f1"](spark, str(tmp_path)).filter("em is not null").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)
    assert got[1, 1][0] == 0 and got[2, 1][0] == 0
