import math
import random
import re

import numpy as np
import pytest

from skydrift.llm import leakage, mixing, pii
from skydrift.llm.pii_training import labelled_texts
from tests.llm.pii_cases import CASES, FRESH

PEOPLE = [("Mirelle", "Pettigroom", "Eastmere"), ("Corvin", "Hörnstett", "Kestrel Bay"), ("Neva", "Ashgrove-Pell", None), (None, None, "Upper Tansy")]


# ---------------------------------------------------------------- leaked passages


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, edits string")


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, doc_id int")


def exact(df):
    return {(r.doc_id, r.item_id) for r in df.where("edits = 0").collect()}


def test_typography_makes_no_difference(spark):
    item = "Reckon the mean rate from 333 empty years and 26 full ones, if each full one brings 32,889 photons."
    same = [
        item.upper(), "x y " + item.replace(" ", "\n> ") + " z", item.replace("mean", "**mean**").replace("rate", "`rate`"), item.replace(",", "").replace(".", ""), item.replace("a", "ａ").replace("fi", "ﬁ"),
        item.replace("empty", "em­p​ty"), item.replace("photons", "pho-\ntons"), "pre " + " ".join(item.split()[:13]) + " post", item.replace("32,889", "32 889"), "<b>Reckon</b> " + item[7:], item.replace("e", "е"),
        "long " * 30000 + item,
    ]
    other = [" ".join(item.split()[:12]) + " post", item.replace("mean", "meanest").replace("full", "fuller").replace("years", "weeks"), "", None, "12 " + " ".join(item.split()[9:])]
    got = exact(leakage.leaked_passages(docs(spark, [*same, *other]), items(spark, [item, "too short", "", None])))
    assert got == {(i, 0) for i in range(len(same))}


def test_leaks_as_by_brute_force_and_recall_of_near_ones(spark):
    rng = random.Random(11)
    voc = vocabulary(rng, 60)
    its = [" ".join(rng.choice(voc) for _ in range(rng.randint(10, 40))) for _ in range(25)]
    texts = []
    for _ in range(160):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.8:
            src = rng.choice(its).split()
            a = rng.randint(0, max(0, len(src) - 12))
            part = src[a : a + rng.randint(9, 20)]
            if rng.random() < 0.6 and part:
                part[rng.randrange(len(part))] = rng.choice(voc)
            p = rng.randint(0, len(w))
            w[p:p] = part
        texts.append(" ".join(w))
    got = leakage.leaked_passages(docs(spark, texts), items(spark, its)).toPandas()
    near = {(r.doc_id, r.item_id): r.edits for r in got.itertuples()}
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k, it in enumerate(its):
            v = it.split()
            for p in range(len(w) - 12):
                for q in range(len(v) - 12):
                    d = sum(x != y for x, y in zip(w[p : p + 13], v[q : q + 13]))
                    if d <= 1:
                        want[i, k] = min(d, want.get((i, k), 9))
    assert {k for k, d in want.items() if d == 0} == {k for k, d in near.items() if d == 0}
    assert set(near) <= set(want) and len(near) >= 0.95 * len(want) and sum(d == 1 for d in want.values()) > 20


def test_words_put_in_left_out_or_exchanged_as_by_brute_force(spark):
    rng = random.Random(5)
    voc = vocabulary(rng, 400)
    its = [" ".join(rng.choice(voc) for _ in range(13 + k % 5)) for k in range(240)]
    texts = []
    for k, it in enumerate(its):
        w = it.split()[:13]
        at = rng.randint(1, 11)
        if k % 3 < 2:
            w[at : at + (k % 3)] = [rng.choice([*voc, "foreign"])]  # put in, exchanged
        else:
            del w[at]
        texts.append(" ".join(["before", *w, "after"]))

    def near(x, y):
        """Edits, if there are at most one (else 2): all but one word lies in common beginnings and ends."""
        if x == y:
            return 0
        p = 0
        while p < min(len(x), len(y)) and x[p] == y[p]:
            p += 1
        e = 0
        while e < min(len(x), len(y)) - p and x[-1 - e] == y[-1 - e]:
            e += 1
        return 1 if max(len(x), len(y)) - p - e <= 1 else 2

    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k, it in enumerate(its):
            v = it.split()
            if len(set(w) & set(v)) < 5:
                continue
            for n in (12, 13, 14):
                for p in range(len(w) - n + 1):
                    for q in range(len(v) - 12):
                        if (d := near(w[p : p + n], v[q : q + 13])) <= 1:
                            want[i, k] = min(d, want.get((i, k), 9))
    got = {(r.doc_id, r.item_id): r.edits for r in leakage.leaked_passages(docs(spark, texts), items(spark, its)).collect()}
    assert {(i, i) for i in range(240)} <= set(want) and set(got) <= set(want) and all(d == want[k] for k, d in got.items())
    for kind in range(3):
        assert sum((i, i) in got for i in range(kind, 240, 3)) >= 0.9 * 80


def test_repetitions_reach_the_recall_or_are_refused():
    rng = np.random.default_rng(3)
    n = leakage.plan_repetitions(13, 1, 10, 0.95, 7)
    a = rng.integers(leakage.FIRST, 500, (600, 13))
    for change in (-1, 0, 1):
        b = []
        for row in a.tolist():
            p = int(rng.integers(1, 12))
            row[p : p + (change < 1)] = [] if change < 0 else [500]
            b.append(row)
        t = leakage.ItemWindows.of(a, np.arange(600), 1, 501, 10, n, 99)
        met = t.candidates(np.array(b))
        assert len(set(met[met[:, 0] == met[:, 1], 0])) >= 0.92 * 600
    with pytest.raises(ValueError):
        leakage.plan_repetitions(13, 6, 39, 0.95, 7, 50)


def test_blocks_of_items_and_repeated_rows(spark):
    rng = random.Random(2)
    voc = vocabulary(rng, 200)
    its = [" ".join(rng.choice(voc) for _ in range(20)) for _ in range(9)]
    d = docs(spark, [its[k] for k in range(9)])
    got = leakage.leaked_passages(d.union(d), items(spark, its).union(items(spark, its)), block_chars=300)
    assert exact(got) == {(k, k) for k in range(9)} and got.count() == 9
    assert leakage.leaked_passages(d.limit(0), items(spark, its)).count() == 0
    assert leakage.leaked_passages(d, items(spark, its).limit(0)).count() == 0


def test_grouped_thousands():
    def slow(ws):
        out, open_ = [], False
        for w in ws:
            digits = w.isdecimal()
            if digits and len(w) == 3 and open_:
                out[-1] += w
            else:
                out.append(w)
                open_ = digits and len(w) <= 3
        return out

    rng = random.Random(4)
    for _ in range(2000):
        ws = [rng.choice(("1", "12", "345", "6789", "a", "b2", "000", "12a")) for _ in range(rng.randint(1, 9))]
        assert leakage.merged(ws) == slow(ws)


def test_edit_distance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(2, 5, (200, 7)), rng.integers(2, 5, (200, 7))

    def slow(x, y):
        row = list(range(len(y) + 1))
        for i, u in enumerate(x):
            new = [i + 1]
            for j, v in enumerate(y):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (u != v)))
            row = new
        return row[-1]

    assert leakage.edit_distance(a, b).tolist() == [slow(x, y) for x, y in zip(a, b)]


# ---------------------------------------------------------------- mixture


def corpus(spark, rows):
    return spark.createDataFrame([(i, s, t, 0) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, copies int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_determinism(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(("the", "track", "bends", "north", "of", "tile")) for _ in range(n))
    rows = [(rng.choice(("big", " Big", "BIG ")), say(rng.randint(5, 60))) for _ in range(300)] + [("small-one", say(20)) for _ in range(12)] + [("other", say(30)) for _ in range(80)] + [(None, say(9)), ("big", None), ("big", ""), ("unused", say(500))]
    want = targets(spark, [("big", 0.5, 2), ("small_one", 0.3, 3), ("other", 0.2, 2), ("absent", 0.0, 2)])
    c, s = mixing.mixture(corpus(spark, rows), want)
    shares = {r.source: r for r in s.collect()}
    assert shares["small_one"].capped and shares["small_one"].most_copies == 3 and not shares["big"].capped
    assert shares["absent"].tokens == 0
    tokens = {i: len(mixing.encoder().encode_ordinary(t)) for i, (_, t) in enumerate(rows) if t}
    total = sum(tokens.values()) / 2
    got = c.collect()
    assert all(1 <= r.copies <= {"big": 2, "small_one": 3, "other": 2}[r.source] and r.n_tokens == tokens[r.doc_id] for r in got)
    assert abs(sum(r.copies * r.n_tokens for r in got) - total) <= 60
    free = total - shares["small_one"].tokens
    assert abs(shares["big"].tokens - free * 5 / 7) <= 31 and abs(shares["other"].tokens - free * 2 / 7) <= 31
    again = mixing.mixture(corpus(spark, rows).repartition(5), want)[0]
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again.collect()}


def test_mixture_of_nothing(spark):
    c, s = mixing.mixture(corpus(spark, []), targets(spark, [("a", 1.0, 2)]))
    assert c.count() == 0 and s.first().tokens == 0
    c, s = mixing.mixture(corpus(spark, [("a", "some text")]), targets(spark, [(None, 0.5, 2), ("a", None, None)]))
    assert c.count() == 0 and s.count() == 1


def test_newton_on_sources_languages_and_length(spark):
    rng = random.Random(8)
    rows = [(s, l_, rng.gauss(0, 1), c, float(rng.randint(5, 300))) for s, c in (("a", 2.0), ("b", 0.6)) for l_ in ("x", "y") for _ in range(60)]
    cells = spark.createDataFrame(rows, "source string, lang string, _z double, _cap double, _t double")
    t = {s: sum(r[4] for r in rows if r[0] == s) for s in "ab"}
    langs = {"x": 0.4 * t["a"], "y": 0.5 * t["a"] + 0.45 * t["b"] - 0.1 * t["a"]}
    tilt, steps = mixing.balance(cells, {"a": 0.8 * t["a"], "b": 0.45 * t["b"]}, langs, 0.5, softness=1e-4)
    rate = lambda r: min(r[3], 0.5 * math.exp(tilt.source[r[0]] + tilt.lang[r[1]] + tilt.length * r[2]))
    got = lambda f: sum(r[4] * rate(r) for r in rows if f(r))
    for s, share in (("a", 0.8), ("b", 0.45)):
        assert abs(got(lambda r: r[0] == s) - share * t[s]) < 1e-5 * t[s]  # noqa: B023
    assert abs(got(lambda r: r[1] == "x") - langs["x"]) < 0.01 * t["a"] and abs(sum(r[4] * rate(r) * r[2] for r in rows)) < 0.01 * t["a"]
    assert len({round(rate(r), 6) for r in rows if r[0] == "a"}) > 50 and 0 < steps < 40


def test_rates_differ_inside_a_source_and_languages_keep_their_share(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(("the", "track", "bends", "north", "of", "tile")) for _ in range(n))
    rows = [("big", rng.choice(("en", "en", "en", "de")), say(rng.randint(5, 60))) for _ in range(400)] + [("small", "de", say(20)) for _ in range(100)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string")
    c, s = mixing.mixture(d, targets(spark, [("big", 0.6, 3), ("small", 0.4, 3)]))
    tokens = {i: len(mixing.encoder().encode_ordinary(r[2])) for i, r in enumerate(rows)}
    got = {r.doc_id: r.copies for r in c.collect()}
    of = lambda f: sum(n * tokens[i] for i, n in got.items() if f(rows[i]))
    total = sum(tokens.values()) / 2
    assert abs(of(lambda r: r[0] == "big") - 0.6 * total) <= 60 and abs(of(lambda r: r[0] == "small") - 0.4 * total) <= 60
    # German is held back inside the big source, as the small one brings more than its share
    share = lambda r0: of(lambda r: r[:2] == ("big", r0)) / sum(tokens[i] for i, r in enumerate(rows) if r[:2] == ("big", r0))
    assert share("de") < 0.8 * share("en")


# ---------------------------------------------------------------- personal information


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "given_name string, family_name string, site string")


def scored(model, labelled):
    """Per type: (found rightly, found wrongly, missed)."""
    n = {k: [0, 0, 0] for k in pii.TYPES}
    for text, gold in labelled:
        got = set(model.decode(text))
        for k, which in enumerate((got & gold, got - gold, gold - got)):
            for g in which:
                n[g[2]][k] += 1
    return n


def test_held_out_accuracy():
    lex = pii.Lexicon.of(PEOPLE)
    model = pii.fitted(lex)
    for kind, (tp, fp, fn) in scored(model, labelled_texts(lex, 400, 991)).items():
        assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > (0.94 if kind == "name" else 0.95), (kind, tp, fp, fn)


def marked(case):
    text, gold, pos = "", set(), 0
    for m in re.finditer(r"\{(\w+)\|([^}]*)\}", case):
        text += case[pos : m.start()]
        gold.add((len(text), len(text) + len(m[2]), m[1]))
        text, pos = text + m[2], m.end()
    return text + case[pos:], gold


def test_accuracy_on_sentences_of_other_origin():
    # every name counts, listed or not; no staff list at all
    n = scored(pii.fitted(pii.Lexicon.of([])), [marked(c) for c in CASES])
    for kind, (tp, fp, fn) in n.items():
        assert tp / (tp + fp) > (0.85 if kind == "name" else 0.95) and tp / (tp + fn) > {"name": 0.75, "id_number": 0.85}.get(kind, 0.95), (kind, tp, fp, fn)


def test_accuracy_on_sentences_never_used_for_the_model():
    n = scored(pii.fitted(pii.Lexicon.of([])), [marked(c) for c in FRESH])
    for kind, (tp, fp, fn) in n.items():
        assert tp / (tp + fp) > 0.85 and tp / (tp + fn) > (0.65 if kind == "name" else 0.95), (kind, tp, fp, fn)


def test_names_no_list_has():
    model = pii.fitted(pii.Lexicon.of([]))
    text = "We met Alice Zimmerman at the dome. He lives at Via Roma 12, 00184 Roma."
    assert {(k, text[a:b]) for a, b, k in model.decode(text)} == {("name", "Alice Zimmerman"), ("address", "Via Roma 12, 00184 Roma")}


def test_decoding_is_the_best_segmentation():
    model = pii.fitted(pii.Lexicon.of(PEOPLE))
    text = "Call Corvin Hörnstett, 415-555-0140 ext. 12, or mail corvin+fps [at] orbit [dot] example."
    segs = [s for s in pii.segments(text, model.lexicon, model.score, model.known)]
    keep = sorted(((a, b, k, x) for a, b, k, x in segs if x + model.gain > 0), key=lambda s: s[:3])

    def step(last, s):
        if last and s[0] - last[1] <= pii.NEAR:
            return model.weights[pii.NEXT].get((last[2], s[2], text[last[1] : s[0]]), 0.0)
        return 0.0

    def best(k, last):
        if k == len(keep):
            return 0.0
        s = keep[k]
        took = step(last, s) + s[3] + best(k + 1, s) if not last or s[0] >= last[1] else -1e9
        return max(best(k + 1, last), took)

    chosen, total, last = model.decode(text), 0.0, None
    by = {s[:3]: s for s in keep}
    for c in chosen:
        s = by[c]
        total, last = total + step(last, s) + s[3], s
    assert len(keep) < 25 and abs(total - best(0, None)) < 1e-9 and len(chosen) == 3


def test_candidates_up_to_the_stated_bounds():
    of = lambda text, kind: {text[a:b] for a, b, k, _ in pii.segments(text, pii.Lexicon.of(PEOPLE)) if k == kind}
    long = " ".join(["Ana"] * (pii.MOST_NAME_WORDS + 1))
    assert " ".join(["Ana"] * pii.MOST_NAME_WORDS) in of(long, "name") and long not in of(long, "name")
    run = " ".join(["12"] * (pii.MOST_GROUPS + 1))
    assert " ".join(["12"] * pii.MOST_GROUPS) in of(run, "phone") and run not in of(run, "phone")
    assert "1" * pii.MOST_DIGITS in of("1" * pii.MOST_DIGITS, "phone") and not of("1" * (pii.MOST_DIGITS + 1), "phone")
    code = "-".join(["A1"] * (pii.MOST_CHUNKS + 1))
    assert "-".join(["A1"] * pii.MOST_CHUNKS) in of(code, "id_number") and code not in of(code, "id_number")
    town = "9 Elm Road, " + " ".join(["Ash"] * (pii.MOST_TOWN_WORDS + 1))
    assert town[:-4] in of(town, "address") and town not in of(town, "address")
    mail = "a" * (pii.MOST_CHARS - 4) + "@b.c"
    assert of(mail, "email") == {mail} and not of("a" + mail, "email")


def test_a_staff_list_too_long_is_cut_to_names_that_occur(spark, people, monkeypatch):
    monkeypatch.setattr(pii, "MOST_STAFF", 3)
    d = spark.createDataFrame([(1, "Neva left."), (2, None)], "doc_id long, text string")
    assert pii.lexicon_of(people, d) == pii.Lexicon(frozenset({"neva"}), frozenset(), frozenset())
    with pytest.raises(ValueError):
        pii.lexicon_of(people)


def test_found_and_redacted(spark, people):
    text = "Dr. Mirelle Pettigroom signed the form with passport ZZ5766613.\nPlease write to Neva Ashgrove-Pell, 182 Quarry Hill,\nKestrel Bay 00123. Runs 530-37-7754 were taken. The Pettigroom estimator gives 2.92. Machine neva-53 lost its disk."
    rows = [(1, text, 5), (1, text, 5), (2, None, 5), (3, "", 5), (None, text, 5), (4, "no one here " * 20000, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, pii_type int")
    got = {(r.doc_id, r.pii_type, r.pii_text) for r in pii.find_pii(d, people).collect()}
    assert got == {(1, "name", "Mirelle Pettigroom"), (1, "id_number", "ZZ5766613"), (1, "name", "Neva Ashgrove-Pell"), (1, "address", "182 Quarry Hill,\nKestrel Bay 00123")}
    red = {r.doc_id: (r.text, r.n_entities) for r in pii.redact_pii(d.where("doc_id is not null").dropDuplicates(["doc_id"]), people).collect()}
    assert red[1][0].startswith("Dr. [NAME] signed the form with passport [ID_NUMBER].\nPlease write to [NAME], [ADDRESS]. Runs 530-37-7754") and red[1][1] == 4
    assert red[2] == (None, 0) and red[3] == ("", 0) and red[4][1] == 0
    assert pii.find_pii(d.limit(0), people).count() == 0 and pii.find_pii(d, people.limit(0)).where("pii_type = 'id_number'").count() == 1


# ---------------------------------------------------------------- sample


def test_photons_are_sampled_at_the_rate_of_their_quarter(spark):
    from skydrift.config import WINDOW_START, WINDOW_STOP
    from skydrift.llm import sampling

    first, last = (str(int(t // sampling.QUARTER_SECONDS)) for t in (WINDOW_START, WINDOW_STOP))
    assert {first, last} <= set(sampling.PHOTON_RATES.by_stratum) and len(sampling.PHOTON_RATES.by_stratum) == int(last) - int(first) + 1
    p = spark.range(20000).selectExpr(f"cast({WINDOW_START} + (id % 2) * {WINDOW_STOP - WINDOW_START} as long) run_id", "id event_id")
    key = lambda d: {(r.run_id, r.event_id) for r in d.collect()}
    got = key(sampling.photon_sample(p))
    assert got == key(sampling.photon_sample(p, sampling.Rates(1 / 50))) and 300 < len(got) < 500
    more = key(sampling.photon_sample(p, sampling.PHOTON_RATES.raised(by_stratum={last: 1.0})))
    assert got < more and sum(r > WINDOW_START + 1 for r, _ in more) == 10000 and {k for k in more if k[0] < WINDOW_START + 1} == {k for k in got if k[0] < WINDOW_START + 1}


def test_stored_rates_are_only_raised(spark, tmp_path):
    from skydrift.llm import sampling

    at = f"file://{tmp_path}/rates"
    quarter = 61 * sampling.QUARTER_SECONDS
    p = spark.range(20000).selectExpr(f"cast({quarter} + (id % 2) * {sampling.QUARTER_SECONDS} as long) run_id", "id event_id")
    key = lambda r: {(x.run_id, x.event_id) for x in sampling.photon_sample(p, r, kept=at).collect()}
    assert sampling.stored_rates(spark, at) is None
    first = key(sampling.Rates(0.02, {"61": 0.1, "62": 0.02}))
    more = key(sampling.Rates(0.02, {"62": 0.05}))  # 61 keeps its rate
    assert first < more and {k for k in first if k[0] < quarter + 1} == {k for k in more if k[0] < quarter + 1}
    assert sampling.stored_rates(spark, at) == sampling.Rates(0.02, {"61": 0.1, "62": 0.05})
    for lower in (sampling.Rates(0.01), sampling.Rates(0.02, {"61": 0.05})):
        with pytest.raises(ValueError):
            key(lower)
    assert key(sampling.Rates(0.02)) == more and len(sampling._versions(spark, at)) == 2
