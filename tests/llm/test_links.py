"""Near-dedup links against all pairs."""

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import simhash  # noqa: E402

from .test_pipeline import alike  # noqa: E402


def classes_of_all_pairs(rows):
    label = {i: i for i, _ in rows}
    for i, t in rows:
        for j, u in rows:
            if i < j and label[i] != label[j] and alike(t, u):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_no_link_of_the_similarity_is_left_out(spark, monkeypatch, few):
    """Short texts, whose fingerprints differ widely at a similarity of 0.8, a chain, a frequent passage and texts without words."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows, passage = [], " ".join(f"p{i}" for i in range(12))
    for group in range(12):
        base = [word() for _ in range(int(rng.integers(12, 70)))]
        for _ in range(5):  # words at the end change: each takes one shingle
            cut_at = int(rng.integers(0, 1 + len(base) // 6))
            rows.append(" ".join(base[: len(base) - cut_at] + [word() for _ in range(int(rng.integers(0, 4)))]))
        rows.append(" ".join(word() for _ in range(10)) + " " + passage)
    chain = [word() for _ in range(80)]
    rows += [" ".join(chain[i : i + 50]) for i in range(0, 30, 4)] + ["", " \n", None, "one", "ONE", "one two"]
    rows = list(enumerate(rows))
    got = {r.doc_id: r.component_id for r in simhash.confirmed_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, prints=1).collect()}
    want = classes_of_all_pairs([(i, t or "") for i, t in rows])
    assert got == want and len(set(want.values())) < len(rows) - 20


def test_a_group_of_near_copies_is_compared_with_its_centre(spark, monkeypatch):
    """Copies on either side of the similarity: rounds and compared pairs grow with the group, not with its square."""
    rng, alike_pairs, rounds = np.random.default_rng(7), simhash._alike, []
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(base)]
    for i in range(100):
        at = set(rng.choice(196, 1 + i % 7, replace=False).tolist())
        rows.append(" ".join(f"x{i}_{k}" if k in at else w for k, w in enumerate(base)))

    def counted(pairs, *args):
        pairs = simhash.cut(pairs)
        rounds.append(pairs.count())
        return alike_pairs(pairs, *args)

    monkeypatch.setattr(simhash, "_alike", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.confirmed_duplicates(docs, shingle=2, prints=1).collect()}
    assert got == classes_of_all_pairs(list(enumerate(rows))) and 10 < len(set(got.values())) < 60
    assert len(rounds) <= 4 and sum(rounds[1:]) < 4 * len(rows)
