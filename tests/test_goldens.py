"""Slow independent versions of the statistics that iterate or draw, and of the assembly, held against the operators."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kmerloom.operators import compactors, fdr, pairs, satc, stats_group
from kmerloom.plans import config, pipeline, postprocess
from kmerloom.sources import reads as R
from kmerloom.sources import sinks

# --- statistics of one table, in plain Python ------------------------------------------------------------------


def plain(x, c, f):
    """(S, sum c^2, sum c sqrt n, M, sums) of a table as a list of rows."""
    rows, cols = range(len(x)), range(len(x[0]))
    n = [sum(x[i][j] for i in rows) for j in cols]
    r = [sum(x[i]) for i in rows]
    m = sum(r)
    s = cc = cn = 0.0
    for j in cols:
        if n[j]:
            s += c[j] * (sum(f[i] * x[i][j] for i in rows) - n[j] * sum(f[i] * r[i] for i in rows) / m) / math.sqrt(n[j])
            cc += c[j] ** 2
            cn += c[j] * math.sqrt(n[j])
    return s, cc, cn, m, n, r


def plain_finite(x, c, f):
    if len(set(c)) == 1 or len(set(f)) == 1 or not any(map(any, x)):
        return 1.0
    s, cc, cn, m, *_ = plain(x, c, f)
    spread = cc - cn**2 / m
    return min(1.0, 2 * math.exp(-2 * s * s / spread)) if spread > 1e-12 else 1.0


def plain_old(x, c, f):
    if len(set(c)) == 1 or len(set(f)) == 1 or not any(map(any, x)):
        return 1.0
    s, cc, cn, m, *_ = plain(x, c, f)
    gamma = cn**2 / (m * cc)
    if not gamma:
        return min(1.0, 2 * math.exp(-2 * s * s / cc))
    share = math.sqrt(gamma) / (1 + math.sqrt(gamma))  # of the budget that goes to the noise of the mean
    return min(1.0, 4 * math.exp(-2 * (1 - share) * s * s / cc))


def plain_effect(x, c, f):
    up, down = ([j for j in range(len(c)) if sign * c[j] > 0] for sign in (1, -1))
    share = lambda js: sum(f[i] * x[i][j] for i in range(len(x)) for j in js) / sum(x[i][j] for i in range(len(x)) for j in js)
    full = lambda js: any(x[i][j] for i in range(len(x)) for j in js)
    return abs(share(up) - share(down)) if full(up) and full(down) else 0.0


def tables(seed, n, rows=5, cols=6, most=12):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        x = rng.poisson(rng.uniform(0.2, most, (rng.integers(2, rows + 1), 1)) * rng.uniform(0.1, 1, (1, rng.integers(2, cols + 1)))).astype(float)
        if x.sum():
            yield x


def test_optimum_over_all_f():
    """For a fixed f the best unit c gives |f' X~|, so the best score is the largest norm over all 2^rows f."""
    hit = 0
    every = list(tables(1, 60))
    for x in every:
        rows, cols = np.flatnonzero(x.sum(1)), np.flatnonzero(x.sum(0))
        if len(rows) < 2 or len(cols) < 2:
            f, c = stats_group.best_cf(x, 20, 50, stats_group.seed_of("A"))
            assert not c.any()
            hit += 1
            continue
        xt = np.array([[(x[i, j] - x[i].sum() * x[:, j].sum() / x.sum()) / math.sqrt(x[:, j].sum()) for j in cols] for i in rows])
        best = max(np.linalg.norm(np.array(f) @ xt) for f in itertools.product((0, 1), repeat=len(rows)))
        f, c = stats_group.best_cf(x, 20, 50, stats_group.seed_of("A"))
        score = abs(f[rows] @ xt @ c[cols])
        assert score <= best + 1e-9
        hit += score >= best - 1e-9
    assert hit >= 0.95 * len(every)


def test_split_is_a_draw_without_replacement():
    """Column totals are exact, and a cell's mean and variance are the hypergeometric ones."""
    col = np.array([12.0, 5, 0, 23])
    got = np.array([stats_group.split_table(col[:, None], 0.25, stats_group.seed_of(str(i)))[:, 0] for i in range(3000)])
    assert (got.sum(1) == 10).all() and (got <= col).all()
    n, k = col.sum(), 10
    mean, var = k * col / n, k * col / n * (1 - col / n) * (n - k) / (n - 1)
    assert got.mean(0) == pytest.approx(mean, abs=0.15) and got.var(0) == pytest.approx(var, abs=0.2)


def test_base_p_by_its_definition():
    """P7 and the old bound: the same draws, scored by the plain formulas."""
    for k, x in enumerate(tables(2, 25)):
        rng, best, old, effect = stats_group.seed_of(str(k)), 1.0, 2.0, 0.0
        for _ in range(20):
            c, f = rng.choice([-1.0, 1.0], x.shape[1]).tolist(), rng.integers(0, 2, len(x)).astype(float).tolist()
            best = min(best, plain_finite(x.tolist(), c, f))
            p = plain_old(x.tolist(), c, f)
            if p < old - 1e-15:
                old, effect = p, plain_effect(x.tolist(), c, f)
        got = stats_group.base_p(x, 20, stats_group.seed_of(str(k)))
        assert got == pytest.approx((min(1.0, 20 * best), min(1.0, 20 * old), effect), rel=1e-9)


def test_optimised_p_is_that_of_the_held_out_part(spark):
    """Train and test are parts of the table, p is the plain formula's on the test part, times the splits."""
    made = {f"A{k}": x for k, x in enumerate(tables(3, 12, most=30))}
    df = spark.createDataFrame([(j, a, f"t{i:02}", int(x[i, j])) for a, x in made.items() for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]], "sample_id int, anchor string, target string, count long")
    got = {r["anchor"]: r for r in stats_group.optimised_stats(df, splits=3, draws=10).collect()}
    for a, x in made.items():
        x = x[x.sum(1) > 0][:, x.sum(0) > 0]
        ps = []
        for k in range(3):
            rng = stats_group.seed_of(a, k)
            train = stats_group.split_table(x, 0.25, rng)
            f, c = stats_group.best_cf(train, 10, 50, rng)
            test = x - train
            ps.append((plain_finite(test.tolist(), c.tolist(), f.tolist()) if c.any() else 1.0, plain_effect(test.tolist(), c.tolist(), f.tolist())))
        best = min(ps, key=lambda v: v[0])
        assert got[a]["pval_opt"] == pytest.approx(min(1.0, 3 * best[0]), rel=1e-9)
        assert got[a]["effect_size_bin"] == pytest.approx(best[1], rel=1e-9, abs=1e-12)


def test_fixed_vectors_by_their_definition(spark):
    """F is the sign of the training table's centred scores, p that of the rest."""
    x = next(tables(4, 1, 5, 6, 40))
    cs = [[(1.0, -1.0, 0.5)[(j + k) % 3] for j in range(x.shape[1])] for k in range(2)]
    df = spark.createDataFrame([(j, "A", f"t{i}", int(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]], "sample_id int, anchor string, target string, count long")
    v = spark.createDataFrame([(j, k, c[j]) for k, c in enumerate(cs) for j in range(x.shape[1])], "sample_id int, j int, c double")
    got = {r["j"]: r for r in stats_group.supervised_stats(df, v).collect()}
    x = x[x.sum(1) > 0][:, x.sum(0) > 0]
    train = stats_group.split_table(x, 0.25, stats_group.seed_of("A"))
    n, r, m = train.sum(0), train.sum(1), train.sum()
    for k, c in enumerate(cs):
        f = []
        for i in range(len(x)):
            z = sum(c[j] * (train[i, j] - r[i] * n[j] / m) / math.sqrt(n[j]) for j in range(x.shape[1]) if n[j])
            f.append(0.5 if abs(z) < 1e-12 else float(z > 0))
        assert got[k]["pval"] == pytest.approx(plain_finite((x - train).tolist(), c, f), rel=1e-9)
        assert got[k]["effect_size_bin"] == pytest.approx(plain_effect((x - train).tolist(), c, f), rel=1e-9)


def test_sampled_edit_distance(spark):
    """Near the exact mean over all pairs of counts."""
    rng = random.Random(5)
    targets = sorted({"".join(rng.choice("ACGT") for _ in range(7)) for _ in range(230)})
    n = [rng.randint(1, 6) for _ in targets]
    df = spark.createDataFrame([(0, "A", t, c) for t, c in zip(targets, n, strict=True)], "sample_id int, anchor string, target string, count long")

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    m = sum(n)
    exact = sum(2 * n[i] * n[j] * edit(targets[i], targets[j]) for i in range(len(n)) for j in range(i)) / (m * (m - 1))
    (r,) = stats_group.sampled_edit(df, 200).collect()
    assert r["avg_edit_distance_all_pairs"] == pytest.approx(exact, abs=0.03)


def test_principal_vectors_of_entries():
    for x in tables(6, 8, 12, 9, 30):
        x = x[x.sum(1) > 0][:, x.sum(0) > 0]
        if min(x.shape) < 3:
            continue
        row, col = (a.ravel() for a in np.nonzero(x.T)[::-1])
        f, c = stats_group.principal(stats_group.centred(x))
        g, d = stats_group.principal(stats_group.centred(stats_group.Sparse(row, col, x[row, col], x.shape)), 5000)
        assert abs(f @ g) == pytest.approx(1, abs=1e-4) and abs(c @ d) == pytest.approx(1, abs=1e-4)


# --- sources and order -----------------------------------------------------------------------------------------


def test_fasta_with_signs_in_headers(spark, tmp_path):
    (tmp_path / "a.fa").write_text("; no record\n>a->b > c\nACGT\nAC\n>\nGG\n>d\r\nT\r\nA\r\n>last")
    got = sorted((r["header"], r["seq"]) for r in R.read_fasta(spark, f"file://{tmp_path}/a.fa").collect())
    assert got == [("", "GG"), ("a->b > c", "ACGTAC"), ("d", "TA"), ("last", "")]


def test_correction_in_ranges_of_equal_p(spark):
    """O1 beyond one task: most p-values are 1, and the ranges cut them by anchor."""
    rng = random.Random(7)
    ps = [(f"a{i:04}", 1.0 if i % 4 else rng.random() ** 4) for i in range(600)] + [("none", None)]
    df = spark.createDataFrame(ps, "anchor string, p double")
    got = {r["anchor"]: r["p_corrected"] for r in fdr.benjamini_yekutieli(df, "p", one_task=50).collect()}
    order = sorted((p, a) for a, p in ps if p is not None)
    h, low, want = sum(1 / i for i in range(1, 601)), 1.0, {"none": None}
    for rank in range(600, 0, -1):
        p, a = order[rank - 1]
        low = min(low, p * 600 * h / rank)
        want[a] = low
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) if want[a] is not None else got[a] is None for a in want)


def test_places_in_ranges(spark):
    rng = random.Random(17)
    made = [(rng.randint(0, 3), f"a{i:03}") for i in range(300)]
    got = fdr.numbered(spark.createDataFrame(made, "s int, a string"), [("s", True), ("a", False)], "at", one_task=20)
    assert [(r["s"], r["a"]) for r in sorted(got.collect(), key=lambda r: r["at"])] == sorted(made, key=lambda x: (-x[0], x[1]))
    assert sorted(r["at"] for r in got.collect()) == list(range(1, 301))


@pytest.mark.parametrize("least", [1, 2, 3, 5, 6])
def test_hamming_filter_by_all_pairs(spark, least):
    rng = random.Random(least)
    made = [(s, f"A{k}", t, 1) for s in range(3) for k in range(25) for t in {"".join(rng.choice("ACGT"[: 1 + k % 4]) for _ in range(6)) for _ in range(rng.randint(1, 5))}]
    by = defaultdict(list)
    for s, a, t, _ in made:
        by[s, a].append(t)
    far = {k for k, ts in by.items() if any(sum(x != y for x, y in zip(p, q, strict=True)) >= least for p, q in itertools.combinations(ts, 2))}
    df = spark.createDataFrame(made, "sample_id int, anchor string, target string, count long")
    assert sorted(tuple(r) for r in satc.hamming_filter(df, least).collect()) == sorted(m for m in made if m[:2] in far)


def test_barcode_knee(spark):
    """A sample of 20 cells of about 300 reads above a thousand barcodes of one to three."""
    rng = random.Random(9)
    made = [("s", f"cell{i:02}") for i in range(20) for _ in range(rng.randint(295, 305))] + [("s", f"noise{i:04}") for i in range(1000) for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(made, "sample_id string, barcode string")
    (r,) = pairs.knee(df).collect()
    assert 4 <= r["least"] <= min(Counter(b for _, b in made if b.startswith("cell")).values())
    assert pairs.knee(df.where("barcode = ''")).count() == 0


def test_report_of_sizes(spark, tmp_path):
    spark.range(1000).write.parquet(f"file://{tmp_path}/t")
    r = sinks.RunReport()
    r.timed("rows", lambda: spark.range(7))
    assert r.sized("t", spark.range(1), f"file://{tmp_path}/t") > 1000 and '"S_t": 0.0' in r.to_json() and '"N_rows": 7' in r.to_json()


# --- assembly --------------------------------------------------------------------------------------------------


def grow_trees(reads, anchors, size, rules):
    """C1 to C9 by dictionaries: {(anchor, id): (parent, compactor, support, exact, specificity, shift, length)}."""
    k, n = rules.kmer_len, rules.num_kmers
    good = lambda s, length: len(s) == length and set(s) <= set("ACGT")

    def after(seeds):
        out = defaultdict(list)
        for s in reads:
            if len(s) < size + n * k:
                continue
            for i in range(len(s) - size + 1):
                if s[i : i + size] in seeds and good(s[i : i + size], size):
                    fs, fine = [], True
                    for j in range(n):
                        f = s[i + size + j * k : i + size + (j + 1) * k]
                        fine = fine and good(f, k)
                        fs.append(f if fine else None)
                    out[s[i : i + size]].append(tuple(fs))
                    if not rules.all_anchors:
                        break
        return out

    def before(extender, gap):
        out = Counter()
        for s in reads:
            for i in range(len(s) - size + 1):
                if s[i : i + size] == extender and i >= gap + size and good(s[i - gap - size : i - gap], size):
                    out[s[i - gap - size : i - gap]] += 1
        return out

    nodes, state = {}, {a: [rules.max_anchor, 0] for a in anchors}
    hits = after(set(anchors))
    todo = [(a, -1, a, a, hits.get(a, [])) for a in sorted(anchors)]  # anchor, id, sequence so far, extender, hits
    while todo:
        new = []
        for a, parent, so_far, ext, rows in sorted(todo, key=lambda t: (t[0], t[1])):
            for i, (ks, total, exact) in enumerate(compactors.chosen(rows, state[a][0], rules)):
                state[a][0] -= i > 0
                new.append((a, state[a][1], parent, so_far + "".join(ks), total, exact, ext))
                state[a][1] += 1
        more = []
        for a, i, parent, whole, total, exact, ext in new:
            spec, shift, own = -2.0, 0, None
            for j in range(rules.num_extenders):
                if spec >= rules.min_specificity:
                    break
                shift = j * rules.extender_shift
                own = whole[len(whole) - size - shift : len(whole) - shift]
                seen = before(own, max(n * k - size - shift, 0))
                spec = seen[ext] / sum(seen.values()) if seen else -1.0
            nodes[a, i] = (parent, whole, total, exact, spec, shift, len(whole))
            if spec >= rules.min_specificity and len(whole) < rules.max_length:
                more.append((a, i, whole[: len(whole) - shift], own))
        first = {}
        for a, i, _, own in sorted(more):
            first.setdefault(own, (a, i))
        hits = after({own for *_, own in more})
        todo = [(a, i, whole, own, hits.get(own, []) if rules.extend_all or first[own] == (a, i) else []) for a, i, whole, own in more]
    return nodes


@pytest.mark.parametrize("shift,extend_all,seed", [(1, False, 1), (2, False, 2), (1, True, 3)])
def test_assembly_against_dictionaries(spark, shift, extend_all, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(90))
    other = base[:45] + "".join(rng.choice("ACGT") for _ in range(45))
    sheet = []
    for i in range(260):
        g = (base, base, other)[i % 3]
        at = rng.randint(0, 40)
        s = list(g[at : at + rng.randint(24, 50)])
        for j in range(len(s)):
            if rng.random() < 0.004:
                s[j] = rng.choice("ACGTN")
        sheet.append("".join(s))
    anchors = [base[4:12], base[20:28], "ACACACAC"]
    rules = compactors.Rules(kmer_len=6, num_kmers=2, lower_bound=3, max_length=50, poly=6, num_extenders=3, extender_shift=shift, min_specificity=0.5, extend_all=extend_all)
    df = spark.createDataFrame(list(enumerate(sheet)), "read_id long, seq string")
    seeds = spark.createDataFrame([(a,) for a in anchors], "anchor string")
    got = compactors.assemble(df, seeds, 8, rules).collect()
    want = grow_trees(sheet, anchors, 8, rules)
    assert len(want) > 4
    mine = {(r["anchor"], r["id"]): (r["parent_id"], r["compactor"], r["support"], r["exact_support"], r["extender_specificity"], r["extender_shift"], r["total_length"]) for r in got}
    assert mine.keys() == want.keys()
    for key, w in want.items():
        assert mine[key][:4] == w[:4] and mine[key][5:] == w[5:] and mine[key][4] == pytest.approx(w[4]), key
    for r in got:
        kids = [w for (a, _), w in want.items() if a == r["anchor"] and w[0] == r["id"]]
        assert r["num_extended"] == len(kids)
        chain, at = [], r["id"]
        while at != -1:
            chain.append(want[r["anchor"], at][2])
            at = want[r["anchor"], at][0]
        assert r["expected_read_count"] == min(chain) and r["cumulated_support"] == ",".join(map(str, chain[::-1]))


def test_files_are_assembled_apart(spark):
    """As if each file were alone."""
    rng = random.Random(11)
    base = ["".join(rng.choice("ACGT") for _ in range(70)) for _ in range(2)]
    start = base[0][:8]
    base[1] = start + base[1][8:]
    sheet = [(f"f{i % 2}", i, base[i % 2][: 30 + i % 35]) for i in range(120)]
    df = spark.createDataFrame(sheet, "file string, read_id long, seq string")
    seeds = spark.createDataFrame([(start,)], "anchor string")
    rules = compactors.Rules(kmer_len=6, num_kmers=2, lower_bound=3, max_length=40, min_specificity=0.5)
    cols = ("anchor", "id", "parent_id", "compactor", "support", "exact_support", "num_extended", "cumulated_support")
    got = sorted((r["file"], *[r[c] for c in cols]) for r in compactors.by_file(df, seeds, 8, rules).collect())
    want = sorted((f, *[r[c] for c in cols]) for f in ("f0", "f1") for r in compactors.assemble(df.where(f"file = '{f}'"), seeds, 8, rules).collect())
    assert got == want and {r[0] for r in got} == {"f0", "f1"}


# --- the whole pipeline ----------------------------------------------------------------------------------------


def test_pipeline_with_all_tables(spark, tmp_path):
    """Flags do what they say, or fail where their table is missing."""
    rng = random.Random(13)
    start, ends = "ACGTTGCA", ("GATTACAGATTACA", "CCTGAGCCTGAGTT")
    tail = "".join(rng.choice("ACGT") for _ in range(30))
    rows = []
    for i in range(1200):
        s = i % 12
        rows.append((s, i, "".join(rng.choice("ACGT") for _ in range(4)) + start + ends[int(s >= 6) if rng.random() < 0.95 else rng.randint(0, 1)] + tail))
    reads = spark.createDataFrame(rows, "sample_id int, read_id long, seq string")
    (tmp_path / "artifacts.txt").write_text("GTTGC\n")
    meta = spark.createDataFrame([(s, "low" if s < 6 else "high") for s in range(12)], "sample_id int, `group` string")
    vectors = spark.createDataFrame([(s, 0, 1.0 if s < 6 else -1.0) for s in range(12)], "sample_id int, j int, c double")
    postprocess.register_postprocess("rows of scores", lambda r: r["scores"].groupBy().count())
    try:
        cfg = config.Config(anchor_len=8, target_len=14, poly_ACGT_len=8, supervised=True, compactors=True, lookup_kmer_len=8, compactors_config={"lower_bound": 3, "max_length": 30}, postprocessing=[{"name": "rows of scores", "input": ["scores"]}])
        genome = pipeline.lookup.genome_table(spark.createDataFrame([("g.fa", "gene one", start + ends[0])], "file string, header string, seq string"), 8)
        got = pipeline.run(reads, cfg, vectors=vectors, metadata=meta, genome=genome)
        scores = got.scores.select("anchor").collect()
        assert start in {r[0] for r in scores} and got.hooks["rows of scores"].first()[0] == len(scores)
        fixed = got.more["fixed_vectors"].where(f"anchor = '{start}'").first()
        assert fixed["pval"] < 1e-6 and fixed["effect_size_bin"] > 0.8
        assert {r["anchor"] for r in got.more["supervised"].select("anchor").collect()} & {r[0] for r in scores}
        assert got.more["compactors"].where("parent_id = -1").count() > 0
        assert any(":" in (r[0] or "") for r in got.more["annotated"].select("most_freq_extendor_1_query_res").collect())
        assert "query_stats" in got.more["annotated_compactors"].columns
    finally:
        postprocess.unregister_postprocess("rows of scores")
    without = pipeline.counts(reads, config.Config(anchor_len=8, target_len=6, artifacts=f"file://{tmp_path}/artifacts.txt"))
    assert start not in {r[0] for r in without.select("anchor").distinct().collect()}
    for bad in (config.Config(supervised=True), config.Config(technology="10x"), config.Config(compactors=True)):
        with pytest.raises(ValueError):
            pipeline.run(reads.drop("read_id"), bad)
    with pytest.raises(ValueError):
        config.Config(cbc_filtering_thr=5).resolve()


def test_pipeline_of_pairs_of_reads(spark):
    """10x: molecules are counted by cell, from r1 (barcode, UMI) and r2."""
    rows = []
    for i in range(240):
        cell, umi = f"{'ACGT'[i % 4] * 4}", f"{i // 4 % 20:03}".translate(str.maketrans("0123456789", "ACGTACGTAC"))
        rows.append((0, cell + umi, "ACGTTGCA" + ("GATTAC", "CCTGAG")[i % 4 > 1]))
    df = spark.createDataFrame(rows, "sample_id int, r1 string, r2 string")
    cfg = config.Config(technology="10x", anchor_len=8, target_len=6, cbc_len=4, umi_len=3)
    got = {(r["barcode"], r["anchor"], r["target"]): r["count"] for r in pipeline.counts(df, cfg).collect()}
    want = Counter((r1[:4], r2[:8], r2[8:]) for r1, r2 in {(r1, r2) for _, r1, r2 in rows})
    assert got == dict(want) and len(got) == 4
