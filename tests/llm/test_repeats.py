"""How often the removal of repeats deals out the texts, and that strings of many entries are settled as those of few."""

import numpy as np
import pytest

from siftlake.llm import repeats


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Texts whose lines stand between others, so triggers have many entries with some strings in common."""
    draw = np.random.default_rng(29)
    words = np.array([f"w{i}" for i in range(400)])
    lines = [" ".join(draw.choice(words, 40)) for _ in range(3)]
    made = [(i, " ".join([*draw.choice(words, 25), lines[i % 3], *draw.choice(words, 25), lines[(i + 1) % 3]])) for i in range(60)]
    folder = str(tmp_path_factory.mktemp("repeats") / "documents.parquet")
    spark.createDataFrame(made, "doc_id long, text string").repartition(3).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("sorted_entries", [4096, 4, 0])
def test_texts_are_read_once_before_the_plan_that_cuts_them(docs, monkeypatch, sorted_entries):
    """Only the parse is written down with texts before it; what needs the texts after that is one plan, whose shuffle of them is shared."""
    written, checkpointed = [], repeats.common.checkpointed

    def seen(df):
        written.append(len(df.inputFiles()) > 0)
        return checkpointed(df)

    monkeypatch.setattr(repeats.common, "checkpointed", seen)
    found = repeats.cut_repeats(docs, 100, sorted_entries)
    assert sum(written) == 1
    assert found.where("size(removed) > 0").count() > 30


def test_many_entries_give_what_few_give(docs):
    few, many, some = (sorted((r["doc_id"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in repeats.cut_repeats(docs, 100, n).collect()) for n in (4096, 0, 4))
    assert few == many == some
