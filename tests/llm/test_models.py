"""Quality rules, classifier, mixing, LM scoring, personal data and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tessera.llm import lm_scoring, mixing, pii, quality_classifier, quality_rules
from tessera.llm.text_stats import matrix

from .conftest import prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics_reference(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    covered = np.zeros(len(w), bool)
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered[k : k + 3] = True
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), int(covered.sum())


def junk(rng, k):
    words = prose(rng, 120).split()
    return [" | ".join(words), " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words), " ".join(["same"] * 200)][k % 3]


@pytest.fixture(scope="module")
def mixed_quality():
    rng = random.Random(11)
    rows = []
    for i in range(500):
        bad = i % 9 == 0
        rows.append((i, junk(rng, i // 9) if bad else prose(rng, rng.choice([60, 120, 300])), rng.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 4}", 0))
    return rows


@pytest.mark.parametrize("groups", [50_000, 0])
def test_quality_rules(spark, corpus, mixed_quality, groups, monkeypatch):
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", groups)
    rows = mixed_quality + [(10_000 + i, t, None, None, 0) for i, t in corpus]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want, r = statistics_reference(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    for i, *_ in mixed_quality:
        assert got[i].kept == (i % 9 != 0)


def test_mcd_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)) * [1, 2, 0.5, 1, 3]
    x[:60] += 40
    rows = spark.createDataFrame([("a", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    p = quality_rules.mcd_distances(rows).first().asDict()
    mean = np.array([p[f"m{i}_f"] for i in range(5)])
    factor = np.zeros((5, 5))
    for i, j in quality_rules.LOWER:
        factor[i, j] = p[f"l{i}{j}_f"]
    clean = x[60:]
    assert np.abs(mean - clean.mean(0)).max() < 0.5
    core = clean[((np.linalg.solve(factor, (clean - mean).T) ** 2).sum(0)) <= 12.83]
    assert np.allclose(np.diag(factor @ factor.T), core.var(0) + 1, rtol=0.25)
    assert ((np.linalg.solve(factor, (x[:60] - mean).T) ** 2).sum(0) > quality_rules.CUTOFF).all()


def test_quality_rules_on_small_and_empty_tables(spark):
    assert quality_rules.quality_rules(table(spark, [])).count() == 0
    rng = random.Random(3)
    few = [(i, prose(rng, 80)) for i in range(5)] + [(5, prose(rng, 80)), (5, "x")]
    got = quality_rules.quality_rules(table(spark, few)).collect()
    assert sorted(r.kept for r in got) == [False] + [True] * 6


def test_quality_classifier(spark, mixed_quality):
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i, *_ in mixed_quality], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(table(spark, mixed_quality + [(9_999, None, "en", "s", 0)]), labels).collect()
    assert len(got) == len(mixed_quality) + 1
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id != 9_999]
    assert np.mean([r.predicted == int(r.doc_id % 9 != 0) for r in held]) > 0.95


def test_labels_of_held_out_rows_do_not_count(spark, mixed_quality):
    own = lambda flip: spark.createDataFrame([(i, int(i % 9 != 0) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0), 0) for i, *_ in mixed_quality], "doc_id long, quality int, toxic int")
    docs = table(spark, mixed_quality)
    scores = [{r.doc_id: round(r.score, 9) for r in quality_classifier.quality_scores(docs, own(f)).collect()} for f in (False, True)]
    assert scores[0] == scores[1]


def test_no_labels_and_empty_tables(spark, mixed_quality):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.quality_scores(table(spark, mixed_quality[:5]), labels).collect()} == {0.5}
    assert quality_classifier.quality_scores(table(spark, []), labels).count() == 0
    assert mixing.mix(table(spark, []), mixing.labelled(labels), mixing.TARGETS).count() == 0
    assert mixing.mix(table(spark, mixed_quality[:5]), mixing.labelled(labels), mixing.TARGETS).count() == 5


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality_classifier.D))
    m = {k: (200 - 50 * k, x[k::2].mean(0), x[k::2].T @ x[k::2] / len(x[k::2])) for k in (0, 1)}
    model = quality_classifier.Discriminant(m)
    _, mean, inverse, half_det = model.classes[1]
    cov = np.linalg.inv(inverse.T @ inverse)
    d = x - mean
    want = -0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(model.log_density(1, x), want)


def test_statistics_are_finite(corpus):
    assert np.isfinite(matrix([t or "" for _, t in corpus])).all()


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_mixing_meets_targets(spark, mixed_quality, floor):
    rows = mixed_quality + [(8_000 + k, t) for k, t in enumerate([None, "", " \n"])]
    labels = spark.createDataFrame([(i, "poor" if i % 9 == 0 else "toxic" if i % 9 == 1 else "good") for i, *_ in mixed_quality if i % 2], "doc_id long, domain string")
    aim = {"good": 0.6, "poor": 0.3, "toxic": 0.1} if not floor else {"good": 0.7, "poor": 0.25, "toxic": 0.05}
    got = mixing.mix(table(spark, rows), labels, aim, growth=1.0 if not floor else 1.5, floor=floor).toPandas()
    assert len(got) == len(rows) and (got["rate"] >= floor).all() and (got["copies"] >= floor).all()
    p = got[["p_good", "p_poor", "p_toxic"]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    n = got["n_tokens"].to_numpy()
    if not floor:
        reached = p.T @ (n * got["rate"].to_numpy())
        assert np.abs(reached / n.sum() - [0.6, 0.3, 0.1]).max() < 0.01
    assert abs((n * got["copies"]).sum() / (n * got["rate"]).sum() - 1) < 0.1


def test_rates_equal_a_direct_solution(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.5, 0.5], 300)
    n = rng.integers(1, 50, 300)
    rows = spark.createDataFrame([(int(i), int(k), *map(float, q)) for i, (k, q) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    goal = n.sum() * np.array([0.2, 0.5, 0.3])
    fit, reached = mixing.fit_rates(rows, goal, 0.0, 8.0)
    assert np.abs(reached - goal).max() < 1e-3 * n.sum()
    r = fit.rates(p)[0]
    assert (r >= 0).all() and np.allclose(p.T @ (n * r), reached)


def test_lm_scores(spark, corpus):
    rng = random.Random(8)
    order = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    plain = [(i, " ".join(order * rng.randint(10, 30))) for i in range(60)]
    mixed = [(100 + i, " ".join(rng.sample(order * 20, 120))) for i in range(3)]
    rows = plain + mixed + [(500, None), (501, ""), (502, "alpha"), (503, "never seen " * 3)]
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(r.n_tokens == len((dict(rows)[i] or "").split()) and r.pll <= 0 for i, r in got.items())
    assert got[500].pll == got[501].pll == 0
    assert min(got[i].mean_pll for i in range(60)) > max(got[100 + i].mean_pll for i in range(3))
    assert lm_scoring.pseudo_likelihood(table(spark, [])).count() == 0


def test_lm_gradient_and_score_equal_brute_force():
    rng = np.random.default_rng(1)
    net = lm_scoring.Network(rng.normal(0, 0.3, sum(int(np.prod(s)) for s in lm_scoring.SHAPES)))
    sides, y = rng.integers(0, lm_scoring.CLASSES + 1, (4, 30)), rng.integers(0, lm_scoring.CLASSES, 30)
    for i in range(5):
        h = np.tanh(sum(net.near[k][sides[k, i]] for k in range(4)) + net.bias)
        z = h @ net.out + net.base
        assert abs(net.score(sides, y)[i] - (z[y[i]] - np.log(np.exp(z).sum()))) < 1e-4
    g = net.gradient(sides, y)
    for at in [5, 2_100, len(net.flat) - 200, len(net.flat) - 3, int(np.argmax(np.abs(g)))]:
        a, b = net.flat.astype(float).copy(), net.flat.astype(float).copy()
        a[at] += 1e-2
        b[at] -= 1e-2
        loss = lambda w: -lm_scoring.Network(w).score(sides, y).mean()
        assert abs((loss(a) - loss(b)) / 2e-2 - g[at]) < 2e-3


def test_neighbours_do_not_cross_texts():
    v = lm_scoring.Vocabulary([("a", 5), ("b", 4)], {s: (10, 3) for s in range(lm_scoring.HASHED)})
    sides, y, _ = lm_scoring.examples([["a", "b"], [], ["b"]], v)
    pad = lm_scoring.PAD
    assert y.tolist() == [0, 1, 1]
    assert sides.T.tolist() == [[pad, pad, 1, pad], [pad, 0, pad, pad], [pad, pad, pad, pad]]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def spans_reference(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    some = ["".join(rng.choices("ab1234567890.@+- ()x", k=rng.randint(0, 80))) for _ in range(4000)]
    some += ["".join(rng.choices("0123456789 -.", k=40)) for _ in range(2000)] + ["a@b@c.d", "a@b.com.d@e.f", "@x.y", "x@y", "é1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "4111 1111-1111 1111", "999.1.1.1 1.1.1.1"]
    assert all(pii.luhn(x) for x in ("4111111111111111", "79927398713")) and not pii.luhn("4111111111111112")
    for t in some:
        assert pii.base_spans(t) == spans_reference(t), t
    assert pii.base_spans("a" * 200_000 + " " + "1" * 200_000) == []


def test_find_pii(spark, corpus):
    rng = random.Random(10)
    rows = [(i, prose(rng, 40) + f" +1 (5{i:02d}) 555-77{i % 90 + 10} " + prose(rng, 10) + (f" mail me{i}@x{i}.example.com " if i % 2 else " 10.0.0.7 ")) for i in range(60)]
    rows += [(900, f"call +1 212 555 7713 {prose(rng, 100)} or 2125557713 now"), (901, None), (902, ""), *[(1000 + i, t) for i, t in corpus]]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base, r = spans_reference(t or ""), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(pii.named(base).split(",")) <= set(r.spans.split(","))
        assert r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)
    assert all(got[1000 + i].n_added == 0 for i, _ in corpus)
    assert pii.find_pii(table(spark, [])).count() == 0


def test_repeated_tokens_get_one_label():
    """With a strong skip potential, a repeat of a known token takes its label, however far away."""
    field = pii.Field(__import__("pandas").DataFrame({k: [] for k in ("sig", "label", "left", "right", "back", "on", "n")}))
    field.skip[:] = 6.0
    sig, clamp = np.array([5, 5, 9]), np.array([4, 0, 0])
    p = field.marginals(sig, np.zeros((2, 0), int), np.array([[0], [1]]), clamp)
    assert p[1].argmax() == 4 and p[2].argmax() == 0


def test_belief_propagation_equals_enumeration_on_a_tree():
    import itertools

    rng = np.random.default_rng(6)
    field = pii.Field(__import__("pandas").DataFrame({k: [] for k in ("sig", "label", "left", "right", "back", "on", "n")}))
    field.node, field.chain, field.skip = rng.normal(size=field.node.shape), rng.normal(size=field.chain.shape), rng.normal(size=field.skip.shape)
    sig, chain, skip = np.array([1, 2, 3, 4]), np.array([[0, 1], [1, 2]]), np.array([[0], [3]])
    total = np.zeros((4, pii.N))
    for y in itertools.product(range(pii.N), repeat=4):
        e = sum(field.node[s, k] for s, k in zip(sig, y)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + (field.skip[y[0]] if y[0] == y[3] else 0)
        for i, k in enumerate(y):
            total[i, k] += np.exp(e)
    assert np.allclose(field.marginals(sig, chain, skip, np.zeros(4, int)), total / total.sum(1, keepdims=True), atol=1e-3)


def chain_text(rng, words, n):
    out = [rng.randrange(len(words))]
    for _ in range(n - 1):
        out.append((out[-1] * 7 + rng.choice([1, 2])) % len(words))
    return " ".join(words[k] for k in out)


def test_lm_beats_a_unigram_model(spark):
    """Also for words that are no classes of their own: 200 words, of which OWN are."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, chain_text(rng, words, 300)) for i in range(400)]
    counts = Counter(w for _, t in rows for w in t.split())
    total = sum(counts.values())
    got = {r.doc_id: r.pll for r in lm_scoring.pseudo_likelihood(table(spark, rows).coalesce(1)).collect()}
    unigram = sum(n * np.log(n / total) for n in counts.values())
    assert sum(got.values()) > 0.9 * unigram


def test_lm_probabilities_sum_to_one(spark):
    """Over all words of a corpus, the probabilities in any one place sum to 1; rare words have their own counts."""
    rng = random.Random(32)
    counts = {f"v{k}": 1 + 4000 // (k + 1) for k in range(5000)}
    by = {}
    hashes = lm_scoring.hash_of(list(counts))
    for s, n in zip(lm_scoring.slots(hashes), counts.values()):
        a, b = by.get(int(s), (0, 0))
        by[int(s)] = (a + n, b + 1)
    v = lm_scoring.Vocabulary(sorted(counts.items(), key=lambda x: -x[1])[:3000], by)
    net = lm_scoring.Network(v.start())
    net.flat += np.random.default_rng(3).normal(0, 0.2, len(net.flat)).astype(np.float32)
    side = [rng.choice(list(counts)) for _ in range(2)]
    total = 0.0
    sides = np.repeat(lm_scoring.examples([[side[0], "v1", side[1]]], v)[0][:, 1:2], len(counts), 1)
    row = v.lookup(hashes)
    y = lm_scoring.OWN + lm_scoring.slots(hashes)
    y[row >= 0] = v.classes[row[row >= 0]]
    logp = net.score(sides, y, lm_scoring.members(row, v))
    for k, (w, n) in enumerate(counts.items()):
        total += np.exp(logp[k] + (v.inner[row[k]] if row[k] >= 0 else np.log(n) - v.shared[y[k] - lm_scoring.OWN]))
    assert abs(total - 1) < 1e-3


def test_lm_tells_words_that_occur_once(spark):
    rng = random.Random(33)
    twin = " ".join(f"rare{k}" for k in range(40))
    rows = [(i, prose(rng, 200) + f" only{i}") for i in range(30)] + [(100, twin), (101, twin), (102, None)]
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(table(spark, rows)).collect()}
    seen = Counter(w for _, t in rows for w in (t or "").split())
    assert {i: r.least_count for i, r in got.items()} == {i: min((seen[w] for w in (t or "").split()), default=0) for i, t in rows}


@pytest.mark.parametrize("size", [3, 40])
def test_lm_vocabulary_beyond_its_size_changes_nothing_but_members(spark, monkeypatch, size):
    """Words outside the broadcast table get their counts by the join."""
    rng = random.Random(34)
    rows = [(i, prose(rng, 60)) for i in range(40)]
    want = Counter(w for _, t in rows for w in t.split())
    monkeypatch.setattr(lm_scoring, "VOCABULARY", size)
    got = {r.doc_id: r for r in lm_scoring.pseudo_likelihood(table(spark, rows), rounds=1).collect()}
    assert {i: r.least_count for i, r in got.items()} == {i: min(want[w] for w in t.split()) for i, t in rows}
    assert all(r.pll < 0 for r in got.values())


def test_a_fitted_field_adds_repeats_and_secrets(spark):
    """Numbers that a rule found, in forms that no rule takes; secrets without their cue; and nothing in clean texts."""
    rng = random.Random(17)
    phone = lambda k: (f"+1 212 5{k % 90 + 10} 77{k % 89 + 10}", f"2125{k % 90 + 10}77{k % 89 + 10}", f"(212) 5{k % 90 + 10}-77{k % 89 + 10}", f"212 5{k % 90 + 10} 77{k % 89 + 10}")
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows, added = [], {}
    for i in range(80):
        full, *other = phone(i)
        rows.append((i, f"{prose(rng, 30)} {full} {prose(rng, 20)}"))
        rows.append((100 + i, f"{prose(rng, 20)} token = \"{key()}\" {prose(rng, 20)} 12 3 {prose(rng, 9)} 2024 {rng.randrange(10**9, 10**10)} x"))
        if i < 12:
            rows.append((200 + i, f"{prose(rng, 10)} {full} {prose(rng, 60)} {other[i % 3]} {prose(rng, 8)}"))
            added[200 + i] = {f"phone:{rows[-1][1].rindex(other[i % 3])}:{rows[-1][1].rindex(other[i % 3]) + len(other[i % 3])}"}
            secret = key()
            rows.append((300 + i, f"secret: {secret} {prose(rng, 60)} {secret} end"))
            added[300 + i] = {f"secret:{m.start()}:{m.end()}" for m in re.finditer(secret, rows[-1][1])}
            rows.append((500 + i, f"{prose(rng, 10)} api_key={secret[::-1]} {prose(rng, 30)} password: '{secret[::-1]}' {prose(rng, 5)}"))
    rows += [(400 + i, f"{prose(rng, 40)} {rng.randrange(10**15, 10**16) // 10 * 10 + 1 if i % 2 else '4.0.'} chapter 12 {prose(rng, 5)}") for i in range(40)]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, rows)).collect()}
    new = {i: set(r.spans.split(",")) - set(pii.named(spans_reference(dict(rows)[i])).split(",")) - {""} for i, r in got.items()}
    assert {i: x for i, x in new.items() if 200 <= i < 400} == added
    assert all(len(new[100 + i]) == 1 and "secret" in min(new[100 + i]) for i in range(80))
    assert not any(new[i] for i in [*range(80), *range(400, 440)])
    for i in range(12):
        t = dict(rows)[500 + i]
        k = re.search("api_key=([0-9a-f]+)", t).group(1)
        assert new[500 + i] == {f"secret:{m.start()}:{m.end()}" for m in re.finditer(k, t)}
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got.values())


def test_belief_propagation_with_loops_is_near_enumeration():
    import itertools

    rng = np.random.default_rng(8)
    field = pii.Field(__import__("pandas").DataFrame({k: [] for k in ("sig", "label", "left", "right", "back", "on", "n")}))
    field.node, field.chain, field.skip = rng.normal(size=field.node.shape), 0.5 * rng.normal(size=field.chain.shape), np.abs(rng.normal(size=field.skip.shape))
    sig, chain, skip = np.array([1, 2, 3, 4]), np.array([[0, 1, 2], [1, 2, 3]]), np.array([[0, 1], [2, 3]])
    total = np.zeros((4, pii.N))
    for y in itertools.product(range(pii.N), repeat=4):
        e = sum(field.node[s, k] for s, k in zip(sig, y)) + sum(field.chain[y[a], y[b]] for a, b in chain.T) + sum(field.skip[y[a]] for a, b in skip.T if y[a] == y[b])
        for i, k in enumerate(y):
            total[i, k] += np.exp(e)
    got = field.marginals(sig, chain, skip, np.zeros(4, int))
    want = total / total.sum(1, keepdims=True)
    assert np.abs(got - want).max() < 0.1 and (got.argmax(1) == want.argmax(1)).all()
