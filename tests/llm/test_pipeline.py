"""The pipeline on a small corpus: every stage's decisions against what was planted."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7)))
    line = lambda n=14: " ".join(word() for _ in range(n)) + "."
    texts = {i: "\n".join(line() for _ in range(8)) for i in range(300)}
    toxic = set(range(0, 120, 4))
    for i in toxic:
        texts[i] += " " + " ".join(r.sample(["zumquat", "zumblest", "vexxor", "vexxing", "zumtar"], 3))
    boiler, passage = line(12), " ".join(word() for _ in range(70))
    for i in (201, 203, 205):
        texts[i] = boiler + "\n" + texts[i]
    texts[211] += " " + passage
    texts[213] = passage + " " + texts[213]
    texts[221] = " ".join(line() for _ in range(8))
    texts[223] = texts[221].upper()  # a copy that lines do not show
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = {x.doc_id: x for x in now.collect()}
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS
    assert set(seen["toxicity"]) == set(texts) - toxic
    cleaned = {i: x.text for i, x in seen["line_dedup"].items()}
    assert set(cleaned) == set(seen["toxicity"])
    assert boiler in cleaned[201] and boiler not in cleaned[203] and boiler not in cleaned[205]
    assert all(cleaned[i] == texts[i] for i in cleaned if i not in (203, 205))
    assert set(seen["near_dedup"]) == set(cleaned) - {223}
    passages = {i: x.text for i, x in seen["substring_dedup"].items()}
    assert passage in passages[211] and passage not in passages[213]
    assert all(passages[i] == cleaned[i] for i in passages if i != 213)
    assert all(x.n_chars == len(x.text) for x in seen["substring_dedup"].values())
    assert set(seen["packing"]) == set(passages)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(passages)
