"""Benchmark items in documents: verbatim, re-parameterised, inconsistent, and plain brute force."""

import random

from samples import docs, sentence

from shelfmark.llm import decontamination

ITEM = "A train leaves Dover at 45 km per hour and meets Alice after 3 hours, then 45 km later it stops near Dover for 3 days."


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, start=1)), "item_id bigint, text string")


def found(spark, texts, benchmark):
    rows = decontamination.contaminated(docs(spark, texts).repartition(3), items(spark, benchmark)).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_reparameterised_item(spark):
    rng = random.Random(1)
    around = lambda t: f"{sentence(rng, 40)}\n{t}\n{sentence(rng, 40)}"
    other = ITEM.replace("45", "1,250.5").replace("Dover", "Lisbon").replace("Alice", "Bob").replace("3 ", "12 ").replace("km", "miles")
    mixed = ITEM.replace("45 km per", "99 km per").replace("near Dover", "near Oslo").replace("3 days", "8 days")
    texts = [around(ITEM), around(other), around(mixed), sentence(rng, 200), around(ITEM[: len(ITEM) // 2])]
    got = found(spark, texts, [ITEM])
    assert set(got) == {(1, 1), (2, 1)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed > 0
    assert got[2, 1].n_kept == got[2, 1].n_slots > 0


def test_units_names_and_numbers(spark):
    df = spark.createDataFrame([("In 1999, old Smith paid 3.50 USD (or 5kg) to Anna. Then Bob | left",)], "text string")
    words = df.select(decontamination.template_words(df.text).alias("w")).first().w
    assert words == ["in", "0", "old", "1", "paid", "0", "2", "or", "02", "to", "1", "then", "1", "left"]


def test_against_plain_windows(spark):
    """Without placeholders the result is the share of five-word windows."""
    rng = random.Random(3)
    benchmark = [sentence(rng, rng.randrange(3, 40)).replace("0", "").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(15)]
    texts = []
    for _ in range(60):
        words = sentence(rng, 50).translate(str.maketrans("0123456789", "abcdefghij")).split()
        own = rng.choice(benchmark).split()
        cut = own[: rng.randrange(len(own)) + 1] if rng.random() < 0.5 else own
        at = rng.randrange(50)
        texts.append(" ".join(words[:at] + cut + words[at:]))
    windows = lambda t: [tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)]
    want = set()
    for i, t in enumerate(texts, start=1):
        have = set(windows(t))
        for j, b in enumerate(benchmark, start=1):
            w = windows(b)
            if w and sum(x in have for x in w) >= 0.8 * len(w):
                want.add((i, j))
    assert set(found(spark, texts, benchmark)) == want and want


def test_filter_keeps_clean_documents(spark):
    rng = random.Random(4)
    rows = docs(spark, [ITEM, None, "", sentence(rng, 30), (None, ITEM), (None, "kept")])
    left = decontamination.without_contaminated(rows, items(spark, [ITEM]))
    assert {r.doc_id for r in left.collect()} >= {2, 3, 4} and 1 not in {r.doc_id for r in left.collect()}
    assert left.columns == rows.columns


def test_typographic_marks_are_no_part_of_words(spark):
    plain = ("it isn't the one that we've found in the old house - they don't say \"who\" had it... "
             "but nobody else there hasn't seen what lay below").lower()
    curly = plain.replace("'", "\u2019").replace(" - ", "\u2014").replace('"who"', "\u201cwho\u201d").replace("...", "\u2026")
    rng = random.Random(8)
    texts = [f"{sentence(rng, 20)} {t} {sentence(rng, 20)}" for t in (plain, curly, curly.replace(" ", "\u00a0"))]
    assert set(found(spark, texts, [plain, curly])) == {(i, j) for i in (1, 2, 3) for j in (1, 2)}


TOM = ("Tom has 5 apples in a basket. Tom gives 2 of them to his sister and walks 3 miles home. "
       "Tom then eats (with Alice) 1 apple before dinner today.")


def test_names_at_any_place_other_blanks_case_and_units(spark):
    rng = random.Random(9)
    other = TOM.replace("Tom", "Bob")
    texts = [TOM, other, TOM.lower(), TOM.replace(" ", "\n\n"), other.replace(" Bob", "\n\nBob").replace("(with Alice)", "(with Carol)"),
             other.replace("miles", "kilometers"), TOM.replace(" ", "  "), TOM.replace("3 miles", "12.5 yards"), sentence(rng, 60),
             TOM.replace("Tom has", "Bob has").replace("Tom gives", "Eve gives").replace("Tom then", "Kim then").replace("5", "6")]
    texts = [f"{sentence(rng, 20)}.\n{t}\n{sentence(rng, 20)}" for t in texts]
    got = found(spark, texts, [TOM])
    assert set(got) >= {(i, 1) for i in range(1, 9)} and (9, 1) not in got
    assert got[1, 1].n_changed == 0 and got[1, 1].n_found == got[1, 1].n_windows
    assert got[2, 1].n_kept == got[2, 1].n_slots and got[2, 1].n_found == got[2, 1].n_windows
    assert (10, 1) not in got or got[10, 1].n_kept < got[10, 1].n_slots


def test_rows_without_an_id_are_judged_by_their_text(spark):
    rows = docs(spark, [ITEM, "clean", (None, ITEM), (None, "kept"), (None, None)])
    left = decontamination.without_contaminated(rows, items(spark, [ITEM])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, ""), (0, "kept"), (2, "clean")]


def slots_by_hand(text):
    """Template words and originals of a text in which capitalised words are names and digits numbers."""
    words = "".join(c if c.isalnum() else " " for c in text).split()
    return [("#" if w[0].isdigit() else "@" if w[0].isupper() else w, w.lower()) for w in words]


def holds(doc, item, width=5):
    """Whether one alignment of the item in the document meets all bounds, found by trying every one."""
    d, b = slots_by_hand(doc), slots_by_hand(item)
    n = len(b) - width + 1
    for shift in range(-len(b), len(d)):
        hits, fixed, pairs = 0, 0, set()
        for i in range(n):
            x, y = b[i:i + width], d[max(0, i + shift):i + shift + width] if i + shift >= 0 else []
            slot = [t in "#@" for t, _ in x]
            if [t for t, _ in x] != [t for t, _ in y] or (slot.count(False) < 2 and x != y):
                continue
            hits += 1
            fixed += slot.count(False)
            pairs |= {(p[1], q[1]) for p, q, s in zip(x, y, slot, strict=True) if s}
        values = {p for p, _ in pairs}
        kept = sum(len({q for p, q in pairs if p == v}) == 1 for v in values)
        same = all(p == q for p, q in pairs)
        if hits and hits >= 0.8 * n and kept >= 0.8 * len(values) and (same or 2 * fixed >= width * hits):
            return True
    return False


def test_against_matching_slots_by_hand(spark):
    """Items and documents made of few words, names and numbers, so that windows match by chance at many places."""
    rng = random.Random(11)
    plain, names = ["has", "gives", "and", "apples", "to", "left"], ["Tom", "Ann", "Bob"]

    def phrase(n):
        return " ".join(rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(names), str(rng.randrange(3, 9))]) for _ in range(n))

    benchmark = ["x " + phrase(rng.randrange(6, 14)) for _ in range(25)]
    texts = []
    for _ in range(120):
        own = rng.choice(benchmark)
        if rng.random() < 0.6:
            swap = {w: rng.choice(names) if w in names else str(rng.randrange(3, 9)) for w in set(own.split()) if w in names or w.isdigit()}
            own = " ".join(swap.get(w, w) if rng.random() < 0.9 else w for w in own.split())
        texts.append(f"y {phrase(rng.randrange(30))} {own} {phrase(rng.randrange(30))}")
    want = {(i, j) for i, t in enumerate(texts, start=1) for j, b in enumerate(benchmark, start=1) if holds(t, b)}
    got = found(spark, texts, benchmark)
    assert len(want) > 30 and want <= set(got)
    # A run of neighbouring alignments may hold an item that no single one does.
    assert len(set(got) - want) <= 0.1 * len(want)


SLOTTED = "compute 5 7 5 7 5 7 5 7 and then report the answer to me"


def test_slots_elsewhere_do_not_drown_a_passage(spark):
    table = ". appendix table " + " ".join(str(n) for n in range(10, 70))
    assert set(found(spark, [SLOTTED, SLOTTED + table, table], [SLOTTED])) == {(1, 1), (2, 1)}


def test_slots_alone_prove_nothing(spark):
    titles = ["Romeo And Juliet By William Shakespeare", "Which Of The Following Is Prime", "1 2 3 5 8 13"]
    contents = "Contents: The Great Gatsby Was Written By Scott Fitzgerald Long Ago in a house"
    texts = [contents, "totals 14 15 92 65 35 89 79 32 and more", f"list: {titles[0]}, {titles[2]}", titles[1].lower(), titles[2] + " 21"]
    assert set(found(spark, texts, titles)) == {(3, 1), (3, 3), (4, 2), (5, 3)}


def test_two_passages_and_an_added_word(spark):
    rng = random.Random(12)
    other = ITEM.replace("45", "60").replace("Dover", "Lisbon").replace("Alice", "Bob").replace("3 ", "9 ")
    longer = ITEM.replace("and meets", "and then slowly meets")
    half = ITEM.split()
    apart = " ".join(half[:12]) + " " + sentence(rng, 60) + " " + " ".join(half[12:])
    texts = [f"{ITEM} {sentence(rng, 50)} {other}", longer, apart]
    got = found(spark, texts, [ITEM])
    assert (1, 1) in got and got[1, 1].n_changed == 0 and (3, 1) not in got


def test_long_text_full_of_slots(spark):
    rng = random.Random(13)
    filler = " ".join(rng.choice(["Alpha", "7", "Beta", "12"]) for _ in range(20_000))
    assert set(found(spark, [f"{filler} {ITEM} {filler}", filler], [ITEM])) == {(1, 1)}


def test_plan_stays_short(spark):
    """The driver prints and ships the plan again with every adaptive step."""
    rows = docs(spark, [ITEM, "clean"])
    df = decontamination.without_contaminated(rows, items(spark, [ITEM]))
    assert len(df._jdf.queryExecution().executedPlan().toString()) < 20_000
    df = decontamination.contaminated(rows, items(spark, [ITEM]))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000
