"""Columns that carry the names operators give, and the pipeline's stages on odd tables."""

import public_tokenizers
import pytest
from odd_documents import SCHEMA, odd_texts, rows

import corpus_pipeline
from catchment.llm import language_id, line_chunks, mixing, piece_codec
from catchment.llm.common import at_most
from catchment.llm.language_id import Letters

MORE = ", __mix string, __LINES int, __pieces string, __language int, __language_ int, __copy int"


@pytest.fixture
def clashing(frame):
    return frame([(*r, "m", 1, "p", 2, 3, 4) for r in rows(odd_texts())], SCHEMA + MORE)


def test_results_take_a_free_name(clashing):
    model = language_id.train({"en": ["the of and that"], "fr": ["le la les des"]})
    n = clashing.count()
    for out, name in ((mixing.with_copies(clashing), "__mix_"), (line_chunks.dedup_lines(clashing), "__lines_"),
                      (language_id.with_language(clashing, model), "__language__"),
                      (piece_codec.with_pieces(clashing, public_tokenizers.path("piece_bpe_32k.model")), "__pieces_")):
        assert out.columns == [*clashing.columns, name] and out.count() == n
        assert {(r["__mix"], r["__language_"]) for r in out.collect()} == {("m", 3)}
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and {r["__copy"] for r in mixed.collect()} == {4}


def test_pipeline_stages_on_odd_rows(spark, clashing):
    left = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "")
        assert left.columns == clashing.columns, name
        assert left.count() > 0, name
    out = corpus_pipeline.STAGES[-1][1](spark, left, "")
    assert out.count() == left.count() and out.filter("NOT round_trip").count() <= 1
    assert left.filter("text IS NULL OR trim(text) = ''").count() == 0


def test_pipeline_stages_on_empty_tables(spark, clashing):
    left = clashing.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, "")
        assert left.count() == 0


def test_letters_by_category():
    words = ["三", "万", "½", "²", "x²", "12", "Ⅷ", "é", "٣"]
    assert Letters(words).counts.astype(bool).tolist() == [True, True, False, False, True, False, False, True, False]


def test_samples_are_cut_alike(frame):
    same = [(1, f"text {i}") for i in range(50)]
    cut = [sorted(tuple(r) for r in at_most(frame(order, "id long, text string").repartition(n), 20).collect())
           for n, order in ((1, same), (5, same[::-1]))]
    assert cut[0] == cut[1] and len(cut[0]) == 20
