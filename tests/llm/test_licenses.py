"""Base phrases against plain search, and templates found in whole files."""

import random
import re

from samples import docs, sentence

from shelfmark.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places, found = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += here
        found |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def test_base_matches_plain_search(spark):
    rng = random.Random(1)
    parts = ["MIT", "License", "license,", "Apache", "apache\tlicense", "general", "Public", "public license", "x", "é", "MIT-License",
             "mit_license", "1", "general public\nLICENSE", "mitlicense", "\x00"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, ""]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts, start=1):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_every_template_is_found_in_a_file(spark):
    rng = random.Random(2)
    texts = [f"{sentence(rng, 50)}\n{text}\n{sentence(rng, 50)}" for _, text, _ in licenses.TEMPLATES]
    # One word added, one word gone: still the same licence.
    bsd = dict((label, text) for label, text, _ in licenses.TEMPLATES)["bsd"]
    texts += [bsd.replace("source and", "source code and").replace("following ", ""), sentence(rng, 500)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, (label, *_) in enumerate(licenses.TEMPLATES, start=1):
        assert label in got[i].labels.split(","), label
        assert got[i].score > 0.9
    n = len(licenses.TEMPLATES)
    assert got[n + 1].labels == "bsd" and got[n + 2].labels == "" and got[n + 2].score == 0


def test_key_phrases_are_mandatory(spark):
    text = dict((label, t) for label, t, _ in licenses.TEMPLATES)["unlicense"]
    got = licenses.scan(docs(spark, [text, text.replace("public domain", "domain public")])).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["unlicense", ""]


def test_all_licences_of_one_file_are_found(spark):
    """Many licences in one file share more rare words than one licence has; each is still found."""
    rng = random.Random(3)
    whole = "\n".join(f"{sentence(rng, 30)}\n{text}" for _, text, _ in licenses.TEMPLATES)
    texts = [whole, f"{licenses.TEMPLATES[4][1]}\n{sentence(rng, 40)}\n{licenses.TEMPLATES[16][1]}", *[sentence(rng, 50)] * 30]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert got[1].labels == ",".join(sorted({label for label, *_ in licenses.TEMPLATES}))
    assert got[1].n_matches >= len(licenses.TEMPLATES) and got[1].score == 1
    assert got[2].labels.split(",") == ["gpl", "zlib"] and got[3].labels == ""
