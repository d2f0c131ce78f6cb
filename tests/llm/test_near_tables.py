"""Near copies write no table that is read once only."""

from earshot.llm import minhash


def test_tables_that_are_read_once_are_not_written(spark, monkeypatch):
    names, keep = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df, name: names.append(name) or keep(df, name))
    texts = [" ".join(f"w{i}_{k % 97 if i == k % 3 else 0}_{j}" for j in range(60)) for k in range(4) for i in range(3)]
    out = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert out.count() == len(texts) and "signed" in names and not {"able", "weighed", "merged"} & set(names) and names.count("classes") <= 1
