"""Planning operators on rows that the tables don't hold."""

import random

from pyspark.sql import functions as F

from tessera.operators import planning as P
from tessera.operators import structure as S


def test_merge_pointers_end_everywhere(spark):
    pointers = {1: None, 2: 1, 3: 2, 4: 3, 5: 99, 6: 7, 7: 8, 8: 6, 9: 7, 10: 10, 11: 4, 0: 9}
    got = P.canonical(spark.createDataFrame(list(pointers.items()), "id long, merged_into long")).collect()
    assert {r.id: r.target for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 1, 0: 6}


def _brute(authors, users):
    out, used = [], {}
    for doc, _, author, surname, initials in sorted(authors):
        best, score = None, 0
        for user, own, theirs in sorted(users):
            n = min(len(initials), len(theirs), 2)
            if user in used.get(doc, ()) or own != surname or initials[:n] != theirs[:n]:
                continue
            if 5 + 2 * n > score:
                best, score = user, 5 + 2 * n
        if best is not None:
            used.setdefault(doc, set()).add(best)
            out.append((doc, author, best, score))
    return sorted(out)


def test_authors_are_matched_in_order(spark):
    authors = [(1, 1, "A. Bee", "bee", "A"), (1, 2, "Bee", "bee", ""), (1, 3, "A. C. Bee", "bee", "AC"), (2, 1, "X. Bee", "bee", "X"), (2, 2, "Cid", "cid", "D"), (3, 1, "AQ Bee", "bee", "AQ")]
    users = [(1, "bee", "AC"), (2, "bee", "A"), (3, "cid", ""), (4, "bee", "B")]
    got = P.match_authors(spark.createDataFrame(authors, "doc long, place long, author string, surname string, initials string"), spark.createDataFrame(users, "user_id long, surname string, initials string"))
    assert sorted(map(tuple, got.collect())) == _brute(authors, users)


def test_namesakes_are_not_paired(spark):
    rng = random.Random(5)
    kinds = ["", "A", "B", "AB", "AC", "ABX", "BB"]
    users = [(i, f"s{rng.randint(0, 4)}", rng.choice(kinds)) for i in range(150)] + [(200, None, "A"), (201, "s1", None)]
    authors = [(rng.randint(0, 9), i, f"a{i}", f"s{rng.randint(0, 6)}", rng.choice(kinds)) for i in range(1500)]
    asked = spark.createDataFrame([*authors, (1, 5000, "n", None, "A"), (1, 5001, "n", "s1", None)], "doc long, place long, author string, surname string, initials string")
    got = P.match_authors(asked, spark.createDataFrame(users, "user_id long, surname string, initials string"))
    assert "Join" not in got._jdf.queryExecution().toString()  # as many rows as authors, not as pairs
    assert sorted(map(tuple, got.collect())) == _brute(authors, users[:150])


def test_quantities(spark):
    rows = [("5 papers and two papers", 7), ("99 papers", 1), ("no number", 1), ("Papers: a; b; ; c", 3), (None, 1), ("0 papers", 1)]
    df = spark.createDataFrame(rows, "s string, want int").select("want", P.quantity(F.col("s"), "papers", {"two": 2}, listed="^papers:").alias("n"))
    assert all(r.n == r.want for r in df.collect())


def test_untyped_pieces_go_with_the_one_before(spark):
    df = spark.createDataFrame([(1, "- Paper one; with a part;\n Grant two ; 12"), (2, ""), (3, None)], "id int, text string")
    got = P.items(df, F.col("piece").rlike("Paper|Grant"), "id").collect()
    assert sorted((r.id, r.item, r.text) for r in got) == [(1, 1, "Paper one; with a part"), (1, 2, "Grant two; 12")]


def test_surnames(spark):
    rows = [("Ivan PETROV", "PETROV"), ("Smith J. A.", "Smith"), ("J. A. Smith", "Smith"), ("Петров Иван Иванович", "Петров"), ("Anna Bee", "Bee"), ("Иван Петров", "Петров")]
    df = spark.createDataFrame(rows, "n string, want string").select("want", S.surname(F.col("n")).alias("s"))
    assert [(r.want, r.s) for r in df.collect()] == [(w, w) for _, w in rows]
