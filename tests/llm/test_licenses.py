"""License scans: matching statistics against substring search, base places against a pattern, chains against known texts."""

import random
import re


from sensorframe.llm import licenses
from sensorframe.llm.licenses import Automaton, Scan, Scanner, scanner

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_words():
    pick = random.Random(1)
    for _ in range(300):
        text = "".join(pick.choice("aZ09é漢 \n\t-_/:@`{~\x7f\x85\xa0İ") for _ in range(40))
        assert [w.decode() for w in licenses.words_of(text)] == plain_words(text)


def test_matching_statistics():
    pick = random.Random(3)
    for _ in range(60):
        sequences = [[pick.randint(0, 2) for _ in range(pick.randint(1, 25))] for _ in range(pick.randint(1, 5))]
        automaton = Automaton(sequences)
        words = [pick.randint(0, 3) for _ in range(60)]
        for i, (state, length) in enumerate(automaton.stream(words), 1):
            def holds(size):
                return [(k, e) for k, s in enumerate(sequences) for e in range(size, len(s) + 1) if s[e - size:e] == words[i - size:i]]
            longest = max(n for n in range(i + 1) if n == 0 or holds(n))
            assert length == longest
            if length:
                assert automaton.ends[state] == sorted(holds(length))


def plain_base(text):
    words = plain_words(text)
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(out)


def test_base_places():
    pick = random.Random(5)
    parts = ["mit", "license", "apache", "general", "public", "the", "gnu", "x", "MIT License", "General-Public\nLicense", "é"]
    s = scanner(Scan())
    for _ in range(400):
        text = " ".join(pick.choice(parts) for _ in range(pick.randint(0, 30)))
        n, places, _ = s.document(text)
        assert (n, sorted((a, s.label[k]) for a, k in places)) == plain_base(text)


def plain_spans(s, text):
    """All matches by substring search, all chains by trying every predecessor."""
    words = [s.vocabulary.get(w, -1 - i) for i, w in enumerate(licenses.words_of(text))]
    sequences = [[s.vocabulary[w] for w in licenses.words_of(t)] for _, t in [*s.names, *((x, t) for x, ts in s.scan.templates.items() for t in ts)][len(s.names):]]
    sequences = [None] * len(s.names) + sequences
    found = []

    def longest(end):
        size = 0
        while size < end and any(words[end - size - 1:end] == q[e - size - 1:e] for q in every for e in range(size + 1, len(q) + 1)):
            size += 1
        return size

    every = sequences[len(s.names):] + [[s.vocabulary[w] for w in licenses.words_of(p)] for p, _ in s.names]
    sizes = [longest(e) for e in range(len(words) + 1)] + [0]
    for end in range(1, len(words) + 1):
        size = sizes[end]
        if size >= 2 and sizes[end + 1] <= size:
            for k, q in enumerate(sequences):
                if q and size >= min(s.scan.least, len(q)):
                    found += [(k, end - size, end, e - size) for e in range(size, len(q) + 1) if q[e - size:e] == words[end - size:end]]
    return sorted(found)


def test_matches_against_search():
    pick = random.Random(9)
    s = Scanner(Scan(phrases={"a b": "ab"}, templates={"x": ("a b c a b d a", "c c a"), "y": ("d a b c d d",)}, least=3, gap=2, cover=0.6))
    for _ in range(200):
        text = " ".join(pick.choice("abcde") for _ in range(pick.randint(0, 40)))
        got = []
        s._chains = lambda matches: got.extend(matches) or []
        s.document(text)
        assert sorted(got) == plain_spans(s, text), text


def test_chains():
    s = Scanner(Scan(phrases={}, templates={"x": ("a b c d e f g h i j",)}, least=2, gap=2, cover=0.7))
    assert s.document("z a b c d e f g h i j z")[2] == [(0, 1, 10, 1.0)]
    assert s.document("a b c d Q f g h i j")[2] == [(0, 0, 9, 0.9)]
    assert s.document("a b c d Q Q Q f g h i j")[2] == []
    assert s.document("f g h i j a b c d e")[2] == []
    assert s.document("a b c d e f g h i j " * 3)[2] == [(0, 0, 9, 1.0), (0, 10, 19, 1.0), (0, 20, 29, 1.0)]
    assert s.document("a b c d e f z")[2] == []


def test_many_copies_stay_fast():
    import time

    begin = time.time()
    text = ("word " * 3 + licenses.TEMPLATES["mit"][1] + " ") * 6000
    n, _, spans = scanner(Scan()).document(text)
    assert len(spans) == 6000 and time.time() - begin < 30


def test_clean_prose_has_no_label():
    s = scanner(Scan())
    for text in ("The work is done and you may use this software for any purpose you like, with or without the others.", "permission to use the file", "license license mit", "as is the case with or without", "public domain"):
        n, places, spans = s.document(text)
        assert not places and not spans, text


def test_report(spark):
    mit = licenses.TEMPLATES["mit"][0]
    changed = mit.replace("associated documentation files", "all of its papers").replace("merge, ", "")
    rows = [
        (1, "Released under the MIT License.\nMIT license"), (2, None), (3, ""), (4, " \n "), (5, f"header words\n{mit}\ntail"), (6, changed.upper()), (None, "Apache-License"),
        (1, "no label here"), (7, "Licensed under the Apache License, Version 2.0."), (8, "the GNU General Public License, version 3"), (9, "x " * 5000), (9, "x " * 5000),
    ]
    df = spark.createDataFrame([(a, b, "clash", 9) for a, b in rows], "doc_id bigint, text string, labels string, n_words int").repartition(3)
    got = licenses.report(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        n, places = plain_base(text)
        want = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in by[doc_id]]
    assert by[5][0].labels == "mit" and by[5][0].base_labels == "" and by[5][0].score == 1.0
    assert by[6][0].labels == "mit" and 0.7 <= by[6][0].score < 1
    assert [r.labels for r in by[7]] == ["apache"] and by[8][0].labels == "gpl" and len(by[9]) == 2
    assert all(r.score == 1.0 for r in got if r.n_base) and all(0 <= r.score <= 1 for r in got)
    assert licenses.report(df.limit(0)).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([(1, "see this: " + licenses.TEMPLATES["isc"][0])], "doc_id bigint, text string")
    r = licenses.scan_documents(df).first()
    assert [(s.label, s.first_word, s.coverage) for s in r.spans] == [("isc", 2, 1.0)] and r.spans[0].last_word == r.n_words - 1
