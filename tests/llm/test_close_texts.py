"""Near-dedup's links of fingerprints."""

from lodestone.llm import near_copies, simhash
from lodestone.llm.workspace import Workspace


def test_near_dedup_checks_the_links_of_fingerprints(spark, monkeypatch):
    base = [f"w{n}" for n in range(300)]
    texts = [" ".join(base), " ".join([*base[:299], "x"]), " ".join(f"u{n}" for n in range(300)), "Same Words here now", "same words HERE now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = simhash.close_texts(docs, Workspace(spark, "close"))
    assert pairs.count() == 2
    # Without the search by shingles, what fingerprints link is still found, checked and dropped.
    search = near_copies._search

    def nothing(*args):
        pairs, crowd, common = search(*args)
        return pairs.limit(0), crowd.limit(0), common

    monkeypatch.setattr(near_copies, "_search", nothing)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 2, 3]
