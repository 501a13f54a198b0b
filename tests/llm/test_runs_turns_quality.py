"""Operators 11 to 13 against brute force, with odd rows, clashing names and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import quality, runs, turns
from folioscope.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()


def plain_runs(w):
    """Every period, every maximal stretch of equal words that far apart; kept if no smaller period holds in it."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q) and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_report(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(left))


def test_runs_of_drawn_words():
    rng = random.Random(5)
    for _ in range(250):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            u = [rng.randrange(3) for _ in range(rng.randint(1, 15))]
            at = rng.randint(0, len(w))
            w[at:at] = (u * 12)[: rng.randint(1, 12 * len(u))]
        assert runs.runs_of(w) == plain_runs(w)
        ((found, n, _),) = runs._found([" ".join(map(str, w))])
        assert (found, n) == (plain_runs(w), len(w))


def test_runs_query(spark):
    got = runs.op11_periodic_runs(spark, SF)
    want = [plain_report(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert any(r[2] for r in want)


def test_runs_odd_rows(spark, tmp_path):
    long_ = "x y z " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 24), (4, "a " * 24), (5, "b " * 23), (None, "c " * 40), (6, long_), (10, "one two")]
    docs = spark.createDataFrame([(*r, "k", {"m": 1}) for r in rows], "doc_id bigint, text string, run_report string, `row.x` map<string,int>")
    out = runs.periodic(docs)
    assert out.columns == ["doc_id", "text", "row.x", "run_report"]
    got = [(r.doc_id, [tuple(x) for x in r.run_report.runs], r.run_report.collapsed) for r in out.collect()]
    a = (4, [(0, 24, 1)], "a")
    assert got == [(1, [], ""), (2, [], ""), (3, [], ""), a, a, (5, [], " ".join("b" * 23)), (None, [(0, 40, 1)], "c"), (6, [(0, 90_000, 3)], "x y z"), (10, [], "one two")]
    assert runs.periodic(docs.limit(0)).count() == 0


def faults_of(rows):
    """rows: (role, text) in order -> fault of each."""
    seen, out = set(), []
    for r in rows:
        core = r[1].strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not core else "duplicate" if r in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add(r)
    return out


def plain_repair(rows):
    """Cheapest edits by trying every assignment of edits and inserts, for few rows."""
    faults, best = faults_of(rows), None
    n = len(rows)
    for choice in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]):
        kept = [(c, r, f) for c, r, f in zip(choice, rows, faults) if c != "D"]
        cost = sum({"D": 4, "K": 0}.get(c, 3) for c in choice) + sum(3 for _, _, f in kept if f == "truncated")
        initials = ["u" if c == "Ru" else "a" if c == "Ra" else r[0][:1] or "!" for c, r, _ in kept]
        for inserts in itertools.product([[], ["u"], ["a"], ["u", "a"], ["a", "u"]], repeat=n + 1):
            more = sum(map(len, inserts))
            if best and cost + 3 * more > best[0]:
                continue
            seq, audit, out, k = [], "", [], 0
            for i in range(n + 1):
                for x in inserts[i]:
                    seq.append(x), out.append(({"u": "user", "a": "assistant"}[x], ""))
                    audit += "I"
                if i < n:
                    audit += choice[i][0]
                    if choice[i] != "D":
                        seq.append(initials[k])
                        role = {"Ru": "user", "Ra": "assistant"}.get(choice[i], rows[i][0])
                        out.append((role, rows[i][1]))
                        k += 1
            if re.fullmatch("(s?(ua)+)?", "".join(seq)):
                now = (cost + 3 * more, audit, out)
                if best is None or now[:2] < best[:2]:
                    best = now
    return best


def test_repair_against_every_edit():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut", "", "Why?", "so it"]
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts)) for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 4]))]
        parse, out = turns.Repair(), []
        for row, fault in zip(rows, faults_of(rows)):
            out += parse.push(*row, ["", "blank", "duplicate", "truncated"].index(fault))
        out += parse.finish()
        cost, audit, kept = plain_repair(rows)
        assert (parse.cost, "".join(e[0] for e in out), [e[1] for e in out if e[1]]) == (cost, audit, kept), rows


def test_repair_settles_long_conversations():
    rng = random.Random(9)
    rows = [(rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "b", "C!"]), rng.choice([0, 0, 0, 1, 3])) for _ in range(4000)]

    def audit(settle):
        parse, out, most = turns.Repair(), [], 0
        parse.due = settle
        for r in rows:
            out += parse.push(*r)
            most = max(most, max(len(a) for _, a, _ in parse.tops.values()))
        return out + parse.finish(), parse.cost, most

    short, plain = audit(turns.SETTLE), audit(10**9)
    assert short[:2] == plain[:2]
    assert short[2] < 400 < plain[2]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for _, r in short[0] if r))


def plain_conversations(rows):
    """The contract over (conv_id, turn, role, text), by dynamic programming over whole audits."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(key.encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: ((r[0] is not None, r[0]), r[1], r[2]))
        named = [t for t, _, _ in held if t is not None]
        gaps = max(named) - min(named) + 1 - len(set(named)) if named else 0
        faults = faults_of([r[1:] for r in held])
        count = Counter(faults)
        initials = [r[1][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        tops = {"": (0, "", [])}
        step = {"": "su", "s": "u", "u": "a", "a": "u"}

        def insert(tops):
            tops = dict(tops)
            for _ in range(3):
                for t, (c, a, o) in list(tops.items()):
                    for x in step[t].replace("s", ""):
                        new = (c + 3, a + "I", o + [({"u": "user", "a": "assistant"}[x], "")])
                        if x not in tops or new[:2] < tops[x][:2]:
                            tops[x] = new
            return tops

        for (_, role, text), fault in zip(held, faults):
            new = {}
            for t, (c, a, o) in insert(tops).items():
                moves = [(t, c + 4, "D", [])]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    if role and role[0] in step[t]:
                        moves.append((role[0], c + more, "K", [(role, text)]))
                    moves += [(x, c + 3 + more, "R", [({"u": "user", "a": "assistant"}[x], text)]) for x in step[t] if x != "s"]
                for to, cost, letter, row in moves:
                    if to not in new or (cost, a + letter) < new[to][:2]:
                        new[to] = (cost, a + letter, o + row)
            tops = new
        cost, audit, kept = min((v for t, v in insert(tops).items() if t in ("", "a")), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, turns.op12_turn_repair(spark, SF).collect()), key=str) == plain_conversations(rows)


def test_repair_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    some = lambda *x: rng.choice(x)
    rows = [(some(None, 1, 2, 3, 77), some(None, *range(9)), some(None, "", "user", "assistant", "system", "tool"), some(None, "", " \n", "Hi.", "Hi", "é?\n")) for _ in range(300)]
    rows += [(5, t, "user", "same.") for t in range(2000)] + rows[:20] + [(6, 1, "user", "long " * 200_000)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, fault int, `held.x` string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    got = turns.op12_turn_repair(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain_conversations(rows)
    assert turns.reported(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "system", "Well."), (2, 0, "user", " ")]
    got = turns.repaired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "place")
    assert [tuple(r) for r in got.collect()] == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "Hi."), (1, 3, "R", "assistant", "Well.")]


def plain_base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(4)
    drawn = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    drawn += ["\n".join(rng.choice(["a b", "a b ", "", " \t", "é ü #", "x|y & z"]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    return [None, "", " \x0b\r\n", "word " * 30_000, "a\x1cb\xa0c", *drawn, *drawn[:5]]


def test_quality_measures(spark):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(odd_texts())], "doc_id bigint, text string, words int, `a.n` string")
    got = quality.measured(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(tuple, got.collect())) == [(i, *plain_base(t)) for i, t in enumerate(odd_texts())]


def exact_tail(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_binomial_bounds(spark):
    ns = [0, 1, 5, 20, 21, 22, 100, 459, 460, 1000, 20_000, 300_000]
    rows = spark.createDataFrame([(n,) for n in ns], "n bigint")
    for p, level in ((0.01, 0.0025), (0.05, 0.01), (0.3, 0.05)):
        for n, k in rows.select("n", quality.allowed(F.col("n"), p, level)).collect():
            assert k < 0 or exact_tail(k, n, p) <= level
            assert exact_tail(k + 1, n, p) > level or k + 1 > n
    pairs = spark.createDataFrame([(0, 1), (3, 40), (19, 1000), (150, 20_000)], "k bigint, n bigint")
    for k, n, tail in pairs.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        assert tail == pytest.approx(exact_tail(k, n, 0.02), rel=1e-9)


def test_quality_risk_is_held(spark):
    """Drawn strata whose good texts hold symbols at a known rate just above the bound: hardly ever a cutoff that loses more."""
    rng, rows = random.Random(8), []
    for s in range(40):
        for i in range(1200):
            good, loud = i < 900, False
            loud = rng.random() < (0.013 if good else 0.9)
            rows.append((s * 10_000 + i, str(s), s * 10_000 + i, 20, 100, 20 if loud else 0, 0, 0, 1, int(good)))
    df = spark.createDataFrame(rows, "doc_id bigint, stratum string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, quality int")
    cuts = quality.cutoffs(df.drop("quality"), df.select("doc_id", "quality")).collect()
    assert len(cuts) <= 2 and all(c.good_lost <= c.allowed for c in cuts)
    # Where good texts are never loud, every stratum gets the cutoff and no good text goes.
    calm = df.withColumn("n_symbols", F.when(F.col("quality") == 1, 0).otherwise(F.col("n_symbols")))
    cuts = quality.cutoffs(calm.drop("quality"), calm.select("doc_id", "quality"))
    assert [(c.rule, c.cut, c.good_lost) for c in cuts.collect()] == [(0, 1000, 0)] * 40
    few = quality.judged(calm, cuts)
    assert few.filter("quality = 1 and not kept").count() == 0 and few.filter("quality = 0 and n_symbols > 0 and kept").count() == 0


def test_quality_odd_rows(spark, tmp_path):
    docs = [(i, t, [None, "", "en"][i % 3], None) for i, t in enumerate(odd_texts())] + [(None, "a b c d e f g h i j k", "en", None)]
    schema = "doc_id bigint, text string, lang string, stratum string"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q, 0) for i in range(100) for q in ([1], [0], [None], [0, 1], [7])[i % 5]] + [(None, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in quality.op13_quality(spark, str(tmp_path)).collect()}
    for i, t, _, _ in docs:
        n, *_, repeats = plain_base(t)
        failed = n < 10 or 100 * repeats > 20 * n
        assert got[i, n] == (failed, not failed)  # too few labels for any cutoff
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert quality.op13_quality(spark, f"{tmp_path}/none").count() == 0
