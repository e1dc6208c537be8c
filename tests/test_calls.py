"""Model calls that are kept: a run that died asks for the rest alone."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.operators import providers, summarize


def fragile(log, switch):
    """A model that writes down what it is asked and dies after twenty calls while ``switch`` exists."""

    class Fragile(providers.LanguageModel):
        def stream(self, messages):
            prompt = messages[-1]["content"]
            if os.path.exists(switch) and os.path.exists(log) and len(open(log).read().splitlines()) >= 20:
                raise RuntimeError("the model is gone")
            with open(log, "a") as f:
                f.write(prompt.replace("\n", " ") + "\n")
            yield "answer to " + prompt

    return Fragile()


def test_a_run_that_died_asks_for_the_rest(spark, tmp_path):
    log, switch, path = str(tmp_path / "log"), tmp_path / "switch", f"file://{tmp_path}/calls"
    switch.write_text("on")
    prompts = spark.createDataFrame([(k, f"prompt {k % 40}") for k in range(60)] + [(90, ""), (91, None)], "id int, prompt string")
    model = fragile(log, str(switch))
    with pytest.raises(Exception, match="the model is gone"):
        providers.complete_stored(prompts, "prompt", model, "said", path, 8)
    kept = {r["answer"].removeprefix("answer to ") for r in spark.read.parquet(f"{path}/answers").collect()}
    before = open(log).read().splitlines()
    switch.unlink()
    got = {r["id"]: r["said"] for r in providers.complete_stored(prompts, "prompt", model, "said", path, 8).collect()}
    assert got == {k: f"answer to prompt {k % 40}" for k in range(60)} | {90: "", 91: ""}
    again = open(log).read().splitlines()[len(before) :]
    assert kept and not kept & set(again) and len(again) == 40 - len(kept)
    providers.complete_stored(prompts, "prompt", model, "said", path, 8).count()
    assert len(open(log).read().splitlines()) == len(before) + len(again)


def test_summaries_with_kept_calls_are_the_same(spark, tmp_path):
    text = "word " * 2500 + "\n" + "more " * 2500
    rows = [("b", f"c{k}", k, f"t{k}", text if k == 1 else f"short {k}") for k in range(3)] + [("b", "c9", 9, "t", " ")]
    chapters = spark.createDataFrame(rows, "book_id string, chapter_id string, sort_order int, title string, content string")
    want = summarize.chapter_summaries(chapters, providers.ExtractiveModel(300), "en").orderBy("chapter_id").collect()
    got = summarize.chapter_summaries(chapters, providers.ExtractiveModel(300), "en", calls=f"file://{tmp_path}/calls")
    assert got.orderBy("chapter_id").collect() == want and len(want) == 3
    books = summarize.book_summaries(got, providers.ExtractiveModel(300), "en", f"file://{tmp_path}/calls")
    assert books.select(F.length("summary")).first()[0] > 0
