"""The hierarchy against a small tree walked in plain Python, on random and on chosen trees."""

import random

import pytest
from pyspark.sql import functions as F

from catchment.operators.hierarchy import (VALUE_LABELS, build_nodes, city_lookup, donor_members,
                                           fill_nodes, keep_informed, mark_nodes, match_regions,
                                           node_values, region_totals)
from catchment.session import materialize

CITY = "tree int, row_id int, NAME_0 string, NAME_1 string, NAME_2 string, NAME_3 string, NAME_4 string, Population double"


class Node:
    def __init__(self, level, path):
        self.level, self.path, self.pop = level, path, 0.0
        self.children, self.served, self.rule = {}, None, None


def grow(cities, on_gap):
    roots = {}
    for _, _, *names, pop in cities:
        if names[0] is None:
            continue
        node = roots.setdefault(names[0], Node(0, (names[0],)))
        node.pop += pop
        for level in range(1, 5):
            if names[level] is None:
                if on_gap == "stop":
                    break
                continue
            node = node.children.setdefault(names[level], Node(level, node.path + (names[level],)))
            node.pop += pop
    return roots


def find(root, name):
    if name == root.path[0]:
        return root
    todo = [root]
    while todo:
        here = todo.pop()
        if name in here.children:
            return here.children[name]
        todo.extend(here.children.values())
    return None


def below(node):
    for child in node.children.values():
        yield child
        yield from below(child)


def fill(roots, parent_wins, small):
    for level in (3, 2, 1):
        for root in roots.values():
            for parent in [root, *below(root)]:
                if parent.level != level - 1:
                    continue
                kids = [c for c in parent.children.values() if c.level == level]
                have = [c for c in kids if c.served is not None]
                pool = sum(c.served for c in have)
                for kid in kids:
                    if kid.served is not None:
                        continue
                    if parent.served is not None and parent.rule is None and not have:
                        kid.rule = "parent"
                    elif parent.served is not None and parent.rule is None:
                        wins = parent.served >= pool if parent_wins else parent.served > pool
                        kid.rule = "parent_larger" if wins else ("pool_larger" if pool > 0 else None)
                    elif have and pool > 0:
                        kid.rule = "pool"
    for root in roots.values():
        if root.served is None:
            continue
        if root.pop < small:
            for kid in root.children.values():
                if kid.level == 1 and kid.served is None and kid.rule is None:
                    kid.rule = "small"
        if not any(n.served is not None or n.rule for n in below(root)):
            for n in below(root):
                n.rule = "country_only"


def lookup(cities, roots, on_gap, small):
    out = {}
    for _, row_id, *names, _ in cities:
        out[row_id] = None
        if names[0] is None:
            continue
        node = root = roots[names[0]]
        for level in range(1, 5):
            if names[level] is None:
                if on_gap == "stop":
                    break
                continue
            node = node.children[names[level]]
            if node.served is not None or node.rule:
                out[row_id] = (level, node.path)
        if out[row_id] is None and root.served is not None and root.pop < small:
            out[row_id] = (0, root.path)
    return out


def random_case(seed):
    rng = random.Random(seed)
    cities = []
    for i in range(rng.randrange(4, 26)):
        names = ["C" if rng.random() < 0.9 else "D"] + [
            None if rng.random() < 0.25 else rng.choice("abcd") for _ in range(4)]
        if rng.random() < 0.05:
            names[0] = None
        if seed % 6 == 0:
            names[1] = None
        cities.append((seed, i, *names, float(rng.randrange(5))))
    regions = []
    known = ["C"] if seed % 6 == 0 else rng.sample(["C", "a", "b", "c", "d", "zz"], rng.randrange(1, 5))
    for name in known:
        regions.append((seed, "C", name, float(rng.choice([0, 0, 1, 2, 3, 4]))))
    return cities, regions


@pytest.mark.parametrize("on_gap,parent_wins", [("skip", False), ("stop", True)])
def test_random_trees(spark, on_gap, parent_wins):
    small = 12.0
    cases = [random_case(s) for s in range(120)]
    # Each tree becomes its own pair of countries, so that one run covers all of them.
    def tag(name, seed):
        return None if name is None else f"{name}{seed}"
    rows, region_rows, expected_nodes, expected_city, expected_match = [], [], {}, {}, {}
    for cities, regions in cases:
        seed = cities[0][0]
        local = [(s, s * 1000 + i, tag(n0, s), n1, n2, n3, n4, p)
                 for s, i, n0, n1, n2, n3, n4, p in cities]
        rows += local
        roots = grow(local, on_gap)
        for s, country, name, served in regions:
            country = tag(country, s)
            name = country if name == "C" else name
            region_rows.append((country, name, served))
            node = find(roots[country], name) if country in roots else None
            if node is not None:
                node.served = served
                expected_match[(country, name)] = node.path
        fill(roots, parent_wins, small)
        for root in roots.values():
            for n in [root, *below(root)]:
                expected_nodes[n.path] = (n.level, n.pop, "own" if n.served is not None else n.rule)
        expected_city.update(lookup(local, roots, on_gap, small))

    cities = spark.createDataFrame(rows, CITY)
    regions = spark.createDataFrame(region_rows, "NAME_0 string, Region string, served double")
    nodes = materialize(build_nodes(cities, "Population", "row_id", on_gap=on_gap))
    matched = materialize(match_regions(nodes, regions))
    assert {(r.country, r.region): tuple(r.path) for r in matched.collect()} == expected_match
    marked = materialize(mark_nodes(nodes, matched, regions, "served"))
    filled = materialize(fill_nodes(marked, parent_wins, small, VALUE_LABELS))
    got = {tuple(r.path): (r.level, r.population, r.rule) for r in filled.collect()}
    assert got == expected_nodes
    rules = {v[2] for v in got.values()}
    assert {"own", "parent", "pool", "parent_larger", "pool_larger"} <= rules
    # A parent that wins ties leaves nothing to the small-country rule.
    if on_gap == "skip":
        assert {"small", "country_only"} <= rules

    found = city_lookup(cities, filled, "row_id", on_gap=on_gap, small_country=small)
    for r in found.collect():
        want = expected_city[r.row_id]
        assert (r.matched_level is None) == (want is None)
        if want:
            assert r.matched_level == want[0]


def table_case(spark):
    """Country P with data at both levels, and the four rows of the fill table."""
    names = [("P", "own"), ("P", "gap"), ("Q", "x"), ("Q", "y"), ("Q", "z"), ("R", "u"), ("S", "v")]
    rows = [(0, i, c, p, None, None, None, 1.0) for i, (c, p) in enumerate(names)]
    return spark.createDataFrame(rows, CITY)


@pytest.mark.parametrize("parent_wins", [False, True])
def test_fill_table_and_tie(spark, parent_wins):
    cities = table_case(spark)
    regions = spark.createDataFrame(
        [("P", "P", 4.0, 1.0), ("P", "own", 4.0, 2.0), ("Q", "x", 1.0, 10.0), ("Q", "y", 3.0, None),
         ("R", "R", 2.0, 5.0)], "NAME_0 string, Region string, served double, val double")
    nodes = build_nodes(cities, "Population", "row_id")
    matched = materialize(match_regions(nodes, regions))
    marked = materialize(mark_nodes(nodes, matched, regions, "served"))
    filled = materialize(fill_nodes(marked, parent_wins, 0.0))
    rules = {"/".join(r.path): r.rule for r in filled.collect()}
    assert rules["P/gap"] == ("parent_larger" if parent_wins else "pool_larger")
    assert (rules["Q/z"], rules["R/u"], rules["S/v"], rules["Q"]) == ("pool", "parent", None, None)
    values = {"/".join(r.path): r.val for r in
              node_values(filled, matched, regions, ["val"], "served").collect()}
    # The sibling without a value still counts in the denominator: 10 · 1 / (1 + 3).
    assert (values["Q/z"], values["R/u"]) == (2.5, 5.0)
    assert values["P/gap"] == (1.0 if parent_wins else 2.0)


def test_walk_prefers_later_parents(spark):
    rows = [(0, 0, "C", "a", "t", None, None, 1.0), (0, 1, "C", "b", "t", None, None, 1.0),
            (0, 2, "C", "b", "s", "deep", None, 1.0), (0, 3, "C", "a", "r", "deep", None, 1.0)]
    nodes = build_nodes(spark.createDataFrame(rows, CITY), "Population", "row_id")
    regions = spark.createDataFrame([("C", "t"), ("C", "deep"), ("C", "a")], "NAME_0 string, Region string")
    got = {r.region: "/".join(r.path) for r in match_regions(nodes, regions).collect()}
    assert got == {"t": "C/b/t", "deep": "C/b/s/deep", "a": "C/a"}


def test_member_weights(spark):
    cities = table_case(spark)
    plants = spark.createDataFrame(
        [(1, "Q", "x", 1.0), (2, "Q", "x", 3.0), (3, "Q", "y", 4.0), (4, "R", "R", 0.0), (5, "R", "R", None),
         (6, "Q", "nan", 5.0)], "plant_id int, NAME_0 string, Region string, served double")
    regions = region_totals(plants, "served")
    nodes = materialize(build_nodes(cities, "Population", "row_id"))
    matched = materialize(match_regions(nodes, regions))
    filled = materialize(fill_nodes(mark_nodes(nodes, matched, regions, "Total_Served_Population")))
    members = materialize(donor_members(plants, matched, filled, "plant_id", "served"))
    got = {(r.donor_id.replace("\u001f", "/"), r.plant_id): r.weight for r in members.collect()}
    assert got == {("node/Q/x", 1): 0.25, ("node/Q/x", 2): 0.75, ("node/Q/y", 3): 1.0,
                   ("pool1/Q", 1): 0.125, ("pool1/Q", 2): 0.375, ("pool1/Q", 3): 0.5,
                   ("node/R", 4): 0.5, ("node/R", 5): 0.5}
    kept = keep_informed(members, spark.createDataFrame([(1,), (3,), (4,)], "plant_id int"), "plant_id")
    got = {(r.donor_id.replace("\u001f", "/"), r.plant_id): r.weight for r in kept.collect()}
    assert got == {("node/Q/x", 1): 1.0, ("node/Q/y", 3): 1.0, ("pool1/Q", 1): 0.2, ("pool1/Q", 3): 0.8,
                   ("node/R", 4): 1.0}


def test_population_text_and_missing_names(spark):
    rows = spark.createDataFrame([(1, "C", "nan", "t", "5"), (2, "nan", "a", "t", "7"), (3, "C", "t", None, "x")],
                                 "row_id int, NAME_0 string, NAME_1 string, NAME_2 string, Population string")
    nodes = build_nodes(rows, "Population", "row_id", ["NAME_0", "NAME_1", "NAME_2"])
    # The same path is reached at levels 2 and 1; the first row decides.
    assert {("/".join(r.path), r.level, r.population) for r in nodes.collect()} == {
        ("C", 0, 5.0), ("C/t", 2, 5.0)}
    assert nodes.where(F.col("country") == "nan").count() == 0
