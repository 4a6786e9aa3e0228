"""Scores over word trigrams."""

import random

from flowloom.llm import queries


def test_word_salad_scores_below_prose(spark, tmp_path):
    draw = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    follow = {w: draw.sample(words, 2) for w in words}
    texts = []
    for _ in range(60):
        text = [draw.choice(words)]
        while len(text) < 80:
            text.append(draw.choice(follow[text[-1]]))
        texts.append(" ".join(text))
    salad = texts[0].split()
    draw.shuffle(salad)
    docs = spark.createDataFrame(list(enumerate([*texts, " ".join(salad)])), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op5_backoff_words"](spark, str(tmp_path)).collect()}
    assert all(r.n_tokens == 80 for r in got.values())
    assert got[60].score < min(got[i].score for i in range(60)) - 0.3
