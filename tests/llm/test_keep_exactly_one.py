"""One member of each class stays, whatever ids its rows have."""

from helpers import table

from cohortlens.llm import jaccard


def family(name, n=60):
    words = [f"{name}{i}" for i in range(n)]
    return [" ".join(words), " ".join([*words, "end"]), " ".join([*words, "more", "end"])]


def test_classes_with_repeated_and_null_ids(spark):
    a, b, c, d, e = (family(x) for x in "abcde")
    rows = [(1, a[0]), (1, a[1]), (1, a[2]),  # one id, other texts
            (None, b[0]), (None, b[1]), (None, b[2]),  # no ids
            (None, c[0]), (9, c[1]), (9, c[1]), (9, c[2]),  # an id goes before none; repeated rows
            (1, d[0]), (1, d[1]), (2, d[2]),  # a class that shares its lowest id with another
            (None, e[0]), (None, e[0]), (3, "alone in the world but with words enough"), (None, None), (4, ""), (4, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(table(spark, rows)).collect()), key=str)
    of = lambda texts: [(i, t) for i, t in kept if t in texts]
    for texts in (a, b, c, d, e):
        assert len(of(texts)) == 1, of(texts)
    assert [of(x)[0][0] for x in (a, b, c, d, e)] == [1, None, 9, 1, None]
    assert len(kept) == 5 + 4
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(table(spark, rows[::-1]).repartition(7)).collect()), key=str) == kept
