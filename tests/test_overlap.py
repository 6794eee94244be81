"""Profile matching by set overlap, against a matrix of all wishes and plans."""

import random

import numpy as np

from pagetide.operators import profiles as PR


def sets(rng, n, names, sizes):
    return [sorted({names[min(int(rng.paretovariate(0.7)) - 1, len(names) - 1)] if rng.random() < 0.3 else rng.choice(names) for _ in range(rng.randint(*sizes))}) for _ in range(n)]


def incidence(rows, names):
    at = {f: k for k, f in enumerate(names)}
    m = np.zeros((len(rows), len(names)), np.float32)
    for k, row in enumerate(rows):
        m[k, [at[f] for f in row]] = 1
    return m


def test_ten_thousand_wishes_and_plans_of_one_host(spark):
    rng = random.Random(9)
    names = [f"field{k}" for k in range(300)]
    wishes, plans = sets(rng, 10_000, names, (3, 8)), sets(rng, 10_000, names, (3, 9))
    urls = spark.createDataFrame([(k, f"https://one.example/a{k % 7}/b/{k}", w) for k, w in enumerate(wishes)], "row int, url string, selected_fields array<string>")
    profiles = spark.createDataFrame([(f"p{k:05d}", "one.example", f"/none{k % 3}", p, True) for k, p in enumerate(plans)], "profile_id string, domain string, path_prefix string, selected_fields array<string>, is_active boolean")
    got = {r["row"]: (r["profile_id"], r["match_score"]) for r in PR.match_profiles(urls, profiles).select("row", "profile_id", "match_score").collect()}
    want, shares = {}, incidence(wishes, names) @ incidence(plans, names).T
    for k, row in enumerate(shares / np.array([[len(w)] for w in wishes])):
        best = int(row.argmax())
        want[k] = (f"p{best:05d}", row[best] * PR.OVERLAP_WEIGHT + PR.OTHER_PREFIX) if row[best] >= PR.MIN_OVERLAP else (None, None)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] is None or abs(v[1] - want[k][1]) < 1e-5 for k, v in got.items())


def test_pairs_below_the_overlap_do_not_leave_the_join(spark):
    rng = random.Random(2)
    names = [f"f{k}" for k in range(25)]
    wishes = list({tuple(w) for w in sets(rng, 300, names, (1, 6))})
    plans = list({tuple(p) for p in sets(rng, 300, names, (1, 7))})
    w = spark.createDataFrame([("h", list(x)) for x in wishes], "_host string, _wanted array<string>")
    o = spark.createDataFrame([("h", list(x), f"{k}") for k, x in enumerate(plans)] + [("other", list(plans[0]), "x")], "_host string, _plan array<string>, profile_id string")
    rows = [(tuple(r["_wanted"]), tuple(r["_plan"]), r["_overlap"]) for r in PR.overlapping(w, o, ["_host"]).collect()]
    want = [(x, p, len(set(x) & set(p)) / len(x)) for x in wishes for p in plans if len(set(x) & set(p)) >= PR.MIN_OVERLAP * len(x)]
    assert sorted(rows) == sorted(want)


def test_wishes_without_fields_and_other_prefixes(spark):
    urls = spark.createDataFrame([(1, "https://h.example/a/b/c", []), (2, "https://h.example/a/b/c", ["x", "y"]), (3, "https://h.example/q", None), (4, "nothing", ["x"])], "row int, url string, selected_fields array<string>")
    profiles = spark.createDataFrame([("p2", "h.example", "/a/b", ["x"], True), ("p1", "h.example", "/z", ["x", "y"], True), ("p0", "h.example", "/a/b", ["y"], False)], "profile_id string, domain string, path_prefix string, selected_fields array<string>, is_active boolean")
    got = {r["row"]: (r["profile_id"], r["match_score"]) for r in PR.match_profiles(urls, profiles).collect()}
    assert got == {1: ("p2", 3.0), 2: ("p1", 2.4), 3: ("p1", 2.4), 4: (None, None)}
