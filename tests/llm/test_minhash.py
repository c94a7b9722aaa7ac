import random

from tagloom.llm import _common, graph, minhash

from .util import collected, documents, odd_rows


def shingles(text, k):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, k))
    ids, root = list(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        c = None if i is None else find(i)
        out.append((i, len(shingles(t, k)), c, i is None or c == i))
    return sorted(out, key=str)


def result(frame, **more):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(frame, **more))), key=str)


def test_families_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = rng.choices(words, k=rng.choice([8, 40, 120]))
        for _ in range(rng.choice([1, 3, 40])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 3 + family, " ".join(own)))
    rng.shuffle(rows)
    assert result(documents(spark, rows), k=4) == brute(rows, 4)


def test_chains_reach_beyond_the_pivot(spark):
    """Neighbours in a chain link, its ends don't: members that the least one doesn't link with are still compared."""
    w = [f"t{i}" for i in range(140)]
    rows = [(i, " ".join(w[i * 4 : i * 4 + 80])) for i in range(12)]
    assert result(documents(spark, rows), k=4) == brute(rows, 4)


def test_odd_rows(spark):
    rows = odd_rows()
    assert result(documents(spark, rows), k=4) == brute(rows, 4)
    assert result(documents(spark, []), k=4) == []


def test_members_of_a_group_are_compared_in_blocks(monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(9)
    rows = []
    for i in range(20):
        own = sorted(rng.sample(range(60), 40)) if i % 2 else [*range(i, i + 40)]
        rows.append((i, i, i % 3 != 0, minhash.np.array(own, minhash.np.uint64).tobytes()))
    sets = {r[0]: set(minhash.np.frombuffer(r[3], minhash.np.uint64).tolist()) for r in rows}
    near = {(a, b) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and (a % 3 or b % 3)}
    got = minhash.block_links(rows, 80)
    assert set(got) <= near

    def parts(links):
        root = {i: i for i in sets}
        for a, b in sorted(links):
            old, new = root[a], root[b]
            root = {i: new if r == old else r for i, r in root.items()}
        return {frozenset(i for i in root if root[i] == r) for r in root.values()}

    assert parts(got) == parts(near)


def test_signature_entries_agree_as_often_as_sets_overlap():
    rng = minhash.np.random.default_rng(1)
    sign = minhash.signer(4000, 1)
    a = rng.integers(0, 2**63, 400, dtype=minhash.np.uint64)
    b = minhash.np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=minhash.np.uint64)])
    assert abs((sign(a) == sign(b)).mean() - 300 / 500) < 0.04


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 105), (105, 203)]
    got = {r["node"]: r["component"] for r in collected(graph.components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 105: 105, 200: 105, 203: 105}
    assert collected(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def test_rows_among_ids(spark, monkeypatch):
    ids = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65535, 65536, 100000, -1, -5, -32768, -40000, 2**40, 2**40 + 3]
    every = [*{*range(-50, 120000, 7), *ids, *(i + 1 for i in ids)}, None]
    docs = documents(spark, [(i, "") for i in every])
    own = spark.createDataFrame([(i,) for i in [*ids * 2, None]], "doc_id long")
    for most in (4096, 0):
        monkeypatch.setattr(_common, "BITMAPS", most)
        inside, outside = _common.among(docs, own)
        assert inside.columns == outside.columns == docs.columns
        assert sorted(r["doc_id"] for r in collected(inside)) == sorted(ids)
        assert sorted((r["doc_id"] for r in collected(outside)), key=str) == sorted(set(every) - set(ids), key=str)
