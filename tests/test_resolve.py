"""Same-batch merging and similar listings against row-by-row and all-pairs passes."""

import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from listmill.functions import vocab as V
from listmill.operators import identity, merge, resolve
from listmill.operators.similar import similar

FIELDS = ["title", "company", "location", "category", "summary", "apply_url", "source_name", "source_url", "external_job_id", "content_hash", "salary_range"]
SCHEMA = ", ".join(f"{c} string" for c in FIELDS)
WORDS = "crane harbour ledger orchard signal timber velvet walnut copper meadow lantern bridge".split()


def pick(rng, seed):
    """A listing of a small world of its own; half of the addresses are one."""
    n = rng.randrange(3)
    summary = " ".join(WORDS[(n * 4 + i) % 12] for i in range(10))
    if rng.random() < 0.5:
        summary += rng.choice([" now", " today", " soon", " again and again in all of the towns"])
    url = f"https://w{seed}.example/{'hot' if rng.random() < 0.5 else rng.randrange(4)}"
    ext = rng.random() < 0.2
    return [
        f"T{seed} {rng.choice('ab')}", rng.choice(["acme", "bolt"]), "harare", "Other", summary, f"https://w{seed}.example/apply{rng.randrange(3)}",
        f"s{seed}" if ext else None, rng.choice([url, url, None]), f"x{rng.randrange(3)}" if ext else None,
        f"h{seed}-{rng.randrange(30)}", rng.choice([None, "low", "high"]),
    ]


def alike(a, b):
    return bool(a and b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9


def same(row, inc):
    if row["content_hash"] == inc["content_hash"]:
        return True

    def key(r):
        return (r["title"].lower(), r["company"], r["location"])

    def ids(r):
        if r["source_name"] and r["external_job_id"]:
            return {("ext", r["source_name"], r["external_job_id"])}
        s, a = r["source_url"], r["apply_url"]
        return ({("s", s)} if s else set()) | ({("a", a)} if a and a != s else set())

    shared = ids(row) & ids(inc)
    if any(k[0] == "ext" for k in shared):
        return True
    if shared and (key(row) == key(inc) or alike(row["summary"], inc["summary"])):
        return True
    return key(row) == key(inc) and alike(row["summary"], inc["summary"])


def row_by_row(stored, incoming, dry_run=False):
    table = [(i, dict(zip(FIELDS, r))) for i, r in stored]
    top, actions = max(i for i, _ in table), []
    for order, values in incoming:
        inc = dict(zip(FIELDS, values))
        hit = next(((i, r) for i, r in table if same(r, inc)), None)
        if hit is None:
            if any(inc[c] is None for c in V.REQUIRED_COLUMNS):
                actions.append((order, "failed", None))
                continue
            top += 1
            if not dry_run:
                table.append((top, inc))
            actions.append((order, "inserted", None if dry_run else top))
            continue
        i, r = hit
        new = {c: v for c, v in inc.items() if v is not None}
        changed = any((r[c] or "").strip() != v.strip() for c, v in new.items())
        if changed and not dry_run:
            r.update(new)
        actions.append((order, "updated" if changed else "skipped", i))
    return actions, table


def worlds(seeds):
    stored, incoming = [], []
    for seed in range(seeds):
        rng = random.Random(seed)
        stored += [pick(rng, seed) for _ in range(4)]
        rows = [pick(rng, seed) for _ in range(6)]
        rows[seed % 6][3] = None
        rows[(seed + 3) % 6] = list(rng.choice(stored[-4:]))
        incoming += rows
    return list(enumerate(stored, 1)), list(enumerate(incoming, 100))


def frames(spark, stored, incoming):
    a = spark.createDataFrame([(i, *r) for i, r in stored], f"id long, {SCHEMA}")
    b = spark.createDataFrame([(i, *r) for i, r in incoming], f"ord long, {SCHEMA}")
    return a.repartition(3), b.repartition(3)


def test_merge_equals_a_row_by_row_pass_over_20_seeds(spark):
    stored, incoming = worlds(20)
    a, b = frames(spark, stored, incoming)
    want, table = row_by_row(stored, incoming)
    snapshot, done = merge.merge_jobs(a, b, "ord")
    got = {r.ord: (r.action, r.id) for r in done.collect()}
    assert got == {o: (act, i) for o, act, i in want}
    assert Counter(act for act, _ in got.values()).keys() == {"inserted", "updated", "skipped", "failed"}
    rows = {r.id: tuple(r[c] for c in FIELDS) for r in snapshot.collect()}
    assert rows == {i: tuple(r[c] for c in FIELDS) for i, r in table}
    # rows that a stored-only match would have got wrong
    dry = {r.ord: (r.action, r.stored_id) for r in merge.merge_actions(a, b, "ord", dry_run=True).collect()}
    assert dry == {o: (act, i if act in ("updated", "skipped") else None) for o, act, i in row_by_row(stored, incoming, dry_run=True)[0]}
    assert dry != {o: (act, i if act in ("updated", "skipped") else None) for o, act, i in want}


def test_merge_of_nothing_and_into_nothing(spark):
    stored, incoming = worlds(1)
    a, b = frames(spark, stored, incoming)
    snapshot, done = merge.merge_jobs(a, b.filter("false"), "ord")
    assert snapshot.count() == len(stored) and done.count() == 0
    snapshot, done = merge.merge_jobs(a.filter("false"), b, "ord")
    assert done.filter("action = 'inserted'").count() == snapshot.count() > 0
    assert snapshot.agg(F.min("id")).first()[0] == 1
    counts = merge.action_counts(done).first().asDict()
    assert sum(counts.values()) == len(incoming) and counts["failed"] == 1


def test_bounds_never_rule_out_a_match(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60)))
        for n in (0, 1, 3, 8):
            u = list(t)
            for _ in range(n):
                u[rng.randrange(len(u))] = rng.choice("xyz")
            texts.append((t, "".join(u)))
    pairs = spark.createDataFrame(texts, "a string, b string")
    rows = pairs.select(
        "a", "b", identity.letters_allow(identity.letter_counts(F.col("a")), identity.letter_counts(F.col("b")), 0.9).alias("letters"),
        identity.ratio_reaches("a", "b", F.lit(0.9)).alias("reaches"),
    ).collect()
    for r in rows:
        assert r.reaches == alike(r.a, r.b)
        assert r.letters or not r.reaches
    assert 20 < sum(r.reaches for r in rows) < len(rows)


def similar_by_hand(jobs, bases, k):
    def words(*texts):
        return {w for t in texts for w in (t or "").lower().split()}

    W = V.SIMILAR_WEIGHTS
    out = set()
    for b in bases:
        ranked = []
        for c in jobs:
            if c["id"] == b["id"]:
                continue
            s = 24 if b["category"] == c["category"] else 8 if "remote" in words(b["category"]) & words(c["category"]) else 0
            s += sum(W[n] for n in ("employment_type", "remote_status", "experience_level") if b[n] and b[n] == c[n])
            s += 8 * len(words(b["title"]) & words(c["title"])) + 10 * len(set(b["tags"].split(",")) & set(c["tags"].split(",")) - {""})
            s += 2 * min(10, len(words(b["summary"]) & words(c["summary"]))) + 3 * min(2, len(words(b["location"]) & words(c["location"])))
            ranked.append((s, c["featured"], c["created_at"], c["id"]))
        out |= {(b["id"], n, r[3], r[0]) for n, r in enumerate(sorted(ranked, reverse=True)[:k], 1)}
    return out


def listings(rng, n, plain):
    """``plain``: one profile for nearly all rows and short texts, so that only text postings tell rows apart."""
    vocabulary = [f"{a}{b}" for a in WORDS for b in ("", "et", "ion")]
    rows = []
    for i in range(n):
        few = plain or rng.random() < 0.3
        rows.append({
            "id": i * 7, "title": "clerk" if few else " ".join(rng.sample(WORDS, 2)), "category": "Other" if few else rng.choice(["Remote Work", "Remote Africa", "Other", "Trade"]),
            "employment_type": "" if few else rng.choice(["", "full", "part"]), "remote_status": None if few else rng.choice([None, "yes"]), "experience_level": "" if few else rng.choice(["", "mid"]),
            "tags": "" if few else ",".join(rng.sample(WORDS, rng.randrange(3))), "location": "" if few else rng.choice(["", "harare", "harare borrowdale"]),
            "summary": " ".join(rng.sample(vocabulary, rng.randrange(0, 4 if plain else 25))), "featured": rng.random() < 0.2, "created_at": f"2024-01-{rng.randrange(1, 29):02d} 00:00:00",
        })
    rows[0].update(title="zzz", category="Solo", tags="", summary="", location="", employment_type="", remote_status=None, experience_level="")
    return rows


def test_similar_equals_all_pairs(spark):
    names = "id long, title string, category string, employment_type string, remote_status string, experience_level string, tags string, location string, summary string, featured boolean, created_at string"
    for seed, n, plain, k in ((1, 150, False, 4), (2, 120, True, 3)):
        rows = listings(random.Random(seed), n, plain)
        jobs = spark.createDataFrame([tuple(r.values()) for r in rows], names.replace("id long, title string, category string", "id long, title string, category string"))
        jobs = jobs.withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(3)
        got = similar(jobs, jobs, F.lit("2024-02-01").cast("date"), k=k, public_only=False)
        assert {(r.id, r["rank"], r.candidate_id, r.score) for r in got.collect()} == similar_by_hand(rows, rows, k)
    some = similar(jobs, jobs.filter("id < 100"), F.lit("2024-02-01").cast("date"), k=k, public_only=False)
    assert {(r.id, r["rank"], r.candidate_id, r.score) for r in some.collect()} == similar_by_hand(rows, [r for r in rows if r["id"] < 100], k)
    assert similar(jobs, jobs.filter("false"), F.lit("2024-02-01").cast("date"), public_only=False).count() == 0
    assert resolve.SPLIT > 1


def test_runs_never_rule_out_a_match_and_tell_texts_of_equal_letters_apart(spark):
    rng = random.Random(8)
    pairs = []
    for case in range(240):
        letters = rng.choice(["etaoin shrdlu cmfw qzxkj", "abcdefghijklmnop ", "aeio ", "".join(map(chr, range(0x4E00, 0x4EA0))) + " "])
        n = rng.choice([3, 9, 60, 198, 199, 200, 201, 420, 1100])
        t = "".join(rng.choice(letters if rng.random() < 0.2 else letters[:8]) for _ in range(n))
        u = list(t)
        for _ in range(int(n * rng.choice([0, 0.004, 0.02, 0.04, 0.06]))):
            at = rng.randrange(len(u))
            kind = rng.randrange(3)
            u[at : at + (kind != 0)] = [rng.choice(letters)] if kind != 1 else []
        if case % 5 == 0:
            at = rng.randrange(len(u))
            u = u[at:] + u[:at] if case % 2 else [*u[: len(u) // 2], *"tail", *u[len(u) // 2 :]]
        pairs += [(t, "".join(u)), ("".join(u), t)]
    words = [t for t, _ in pairs if len(t) > 1000 and identity.seeds(t) <= 40]
    shuffled = [(t, "".join(rng.sample(t, len(t)))) for t in words]
    df = spark.createDataFrame(pairs + shuffled, "a string, b string").repartition(4)
    sk = df.select("a", "b", identity.text_sketch("a").alias("ra"), identity.text_sketch("b").alias("rb"))
    rows = sk.select(
        "a", "b", identity.runs_allow(F.col("ra.bits"), F.col("rb.bits"), F.length("a"), F.length("b"), F.col("rb.seeds"), 0.9).alias("runs"),
        identity.letters_allow(identity.letter_counts(F.col("a")), identity.letter_counts(F.col("b")), 0.9).alias("letters"),
    ).collect()
    near = [r for r in rows if alike(r.a, r.b)]
    assert len(near) > 150 and all(r.runs for r in near)
    assert sum(not r.runs for r in rows) > 20
    mixed = {b for _, b in shuffled}
    assert mixed and all(r.letters and not r.runs for r in rows if r.b in mixed and not alike(r.a, r.b))


def test_dry_run_compares_with_stored_values_alone(spark):
    kept = ["T", "acme", "harare", "Other", "", "https://d.example/a", "s", "https://d.example/1", "x", "h1", "low"]
    raised = [*kept[:-1], "high"]
    a, b = frames(spark, [(1, kept)], [(10, raised), (11, kept)])
    dry = {r.ord: (r.action, r.stored_id) for r in merge.merge_actions(a, b, "ord", dry_run=True).collect()}
    assert dry == {10: ("updated", 1), 11: ("skipped", 1)}


def test_ratio_equals_the_public_matcher_without_visiting_popular_letters():
    rng = random.Random(11)
    for letters in ("ab", "abcdefgh ", "etaoin shrdlu cmfwyp vbgkqjxz"):
        for size in (0, 1, 7, 60, 199, 200, 201, 700):
            for edits in (0, 3, 40):
                a = [rng.choice(letters) for _ in range(size)]
                b = list(a)
                for _ in range(edits):
                    b.insert(rng.randrange(len(b) + 1), rng.choice(letters))
                a, b = "".join(a), "".join(b)
                assert identity.ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()

    class Watched(str):
        visits = 0

        def __getitem__(self, i):
            Watched.visits += 1
            return super().__getitem__(i)

    words = " ".join(rng.choice(WORDS) for _ in range(400))[:2000]
    a, b = Watched(words + "q"), words[::-1] + "q"
    identity.ratio(a, b)
    assert Watched.visits < 2_000
