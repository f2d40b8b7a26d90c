"""Every operator and pipeline stage over odd rows and empty tables."""

import pytest
from samples import empty, labels, odd, odd_labels, odd_rows

import corpus_pipeline
from shelfmark.llm import decontamination, licenses, mixing, neardup, pii, quality, scoring, toxicity

ROWS = len(odd_rows())


def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, "no id here at all")], "item_id bigint, text string")


OPERATORS = {
    "licenses": lambda s, d: licenses.scan(d),
    "scoring": lambda s, d: scoring.katz_scores(d),
    "mixing": lambda s, d: mixing.mix_sources(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, odd_labels(s)),
    "pii": lambda s, d: pii.personal_data(d),
    "neardup": lambda s, d: neardup.linked(d, 2),
    "quality": lambda s, d: quality.score_quality(d, odd_labels(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    rows = OPERATORS[name](spark, odd(spark)).collect()
    assert len(rows) == ROWS
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in odd_rows())
    twice = [r for r in rows if r.doc_id == 6]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


def test_empty_labels(spark):
    none = labels(spark, [])
    for df in (toxicity.toxicity(odd(spark), none), quality.score_quality(odd(spark), none)):
        assert all(r.score == 0.5 for r in df.collect())


def test_contaminated_pairs(spark):
    rows = decontamination.contaminated(odd(spark), bench(spark)).collect()
    assert [(r.doc_id, r.item_id, r.n_found, r.n_windows) for r in rows] == [(None, None, 1, 1)]
    assert decontamination.contaminated(empty(spark), bench(spark)).count() == 0
    assert decontamination.contaminated(odd(spark), bench(spark).limit(0)).count() == 0


class Tables:
    """Stands in for the tables a stage reads besides its documents."""

    @staticmethod
    def write(spark, folder):
        odd_labels(spark).write.parquet(f"{folder}/labels.parquet")
        bench(spark).write.parquet(f"{folder}/benchmark.parquet")
        return str(folder)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    folder = Tables.write(spark, tmp_path)
    rows = odd(spark)
    out = stage(spark, rows, folder)
    kept = out.collect()
    if name != "mixing":
        assert out.schema == rows.schema
        assert {r.doc_id for r in kept} >= ({2, 3} if name == "toxicity" else {2, 3, 5, 8, 10})
    assert {r.doc_id for r in kept} <= {r[0] for r in odd_rows()}
    assert stage(spark, empty(spark), folder).count() == 0


def test_stage_effects(spark, tmp_path):
    folder = Tables.write(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    kept = [r.doc_id for r in stages["minhash_dedup"](spark, odd(spark), folder).collect()]
    assert kept.count(6) == 1 and 7 not in kept and 12 not in kept and None in kept
    clean = {r.doc_id: r for r in stages["pii"](spark, odd(spark), folder).collect()}
    assert clean[10].text == "Größe été \U0001f600 mail <email> \U0001f600" and clean[10].n_chars == len(clean[10].text)
    assert clean[1].text is None and clean[4].text == "one" and clean[4].n_chars == 3


def test_stage_order_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "pii", "mixing"]
