"""The registered queries against their SQL, and the pipeline's stages against plain forms."""

import random

import corpus_pipeline
import duckdb
import pytest
from llm_helpers import words
from test_decontaminate import brute as brute_contamination
from test_near_dedup import brute as brute_components
from test_quality_rules import brute as brute_counts
from test_substring_dedup import brute as brute_repeats

from corpusloom.llm.oracle import ORACLE
from corpusloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in "documents pages benchmark labels conversations".split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    result = QUERIES[name](spark, SF_DIR)
    assert sorted(result.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in result.select(*columns).collect()) == sorted(map(repr, cursor.fetchall()))


def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it made of it."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF_DIR).cache()
        out.append((name, docs, result))
        docs = result
    return {name: (given, made) for name, given, made in out}


def _rows(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == stages[name][0].columns


def test_quality_stage_drops_what_fails(stages):
    given, made = map(_rows, stages["quality_rules"])
    kept = {i for i, _ in made}
    assert 0 < len(kept) < len(given)
    for i, text in given:
        counts = brute_counts(text)
        if counts[0] < 10 or 100 * counts[4] > 20 * counts[0]:
            assert i not in kept


def test_near_stage_keeps_one_of_each_group(stages):
    given, made = map(_rows, stages["near_dedup"])
    assert sorted(made) == sorted(r for r in given if brute_components(given)[r[0]][2])


def test_substring_stage_cuts_repeats(stages):
    given, made = stages["substring_dedup"]
    lost = {r[0]: r[2] for r in brute_repeats(_rows(given))}
    before, after = dict(_rows(given)), {r.doc_id: r for r in made.collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        assert len(words(after[i].text)) == len(words(text)) - lost[i] and after[i].n_chars == len(after[i].text)
        assert lost[i] or after[i].text == text


def test_decontamination_stage_drops_the_contaminated(spark, stages):
    given, made = map(_rows, stages["decontaminate"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute_contamination([t for _, t in given], items)
    assert sorted(made) == sorted(r for k, r in enumerate(given) if not judged[k][4])


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(str, rows)) == sorted(map(str, stages["sentence_pieces"][1].collect()))
    assert all(len(r.ids) == r.n_tokens for r in random.Random(0).sample(rows, min(20, len(rows))))
