import random
from datetime import datetime, timedelta

from sparkrag.operators import threads


def plain_sessions(times, cap):
    out, no, size, last = [], 0, 0, None
    for t in times:
        if last is None or size >= cap or t - last > timedelta(minutes=10):
            no, size = no + 1, 0
        out.append(no)
        size, last = size + 1, t
    return out


def test_sessions_equal_the_sequential_rule(spark):
    rnd, start = random.Random(1), datetime(2024, 1, 1)
    rows, want = [], {}
    for user in range(12):
        t, times = start, []
        for _ in range(rnd.randint(1, 90)):
            t += timedelta(seconds=rnd.choice([1, 60, 600, 601, -300, 599]), microseconds=rnd.choice([0, 1]))
            times.append(t)
        ids = [1000 * user + 3 * i for i in range(len(times))]
        rows += list(zip([user] * len(ids), ids, times))
        want |= dict(zip(ids, plain_sessions(times, 5)))
    df = spark.createDataFrame(rows, "u int, id long, ts timestamp_ntz")
    for span in (7, 1 << 16):
        got = {r["id"]: r["window_no"] for r in threads.sessions(df, "u", "ts", "id", cap=5, span=span).collect()}
        assert got == want
    minutes = spark.createDataFrame([(1, i, start + timedelta(minutes=m)) for i, m in enumerate((0, -30, 5))], "u int, id long, ts timestamp_ntz")
    assert [r["window_no"] for r in threads.sessions(minutes, "u", "ts", "id").orderBy("id").collect()] == [1, 1, 2]


def plain_expand(topics, seeds, previous, following, top_k):
    out = []
    at = {p: (t, i) for t, ps in topics.items() for i, p in enumerate(ps)}
    for s in seeds:
        if s in at:
            t, i = at[s]
            for o in (0, *range(1, following + 1), *range(-1, -previous - 1, -1)):
                if 0 <= i + o < len(topics[t]) and topics[t][i + o] not in out:
                    out.append(topics[t][i + o])
    return out[:top_k]


def test_expansion_equals_the_sequential_rule(spark):
    rnd = random.Random(2)
    topics = {f"t{t}": [f"{t}-{n}" for n in sorted(rnd.sample(range(40), rnd.randint(1, 9)))] for t in range(6)}
    posts = spark.createDataFrame([(t, p, int(p.split("-")[1]), "") for t, ps in topics.items() for p in ps], "topic_id string, post_id string, post_number int, posted_at string")
    placed = threads.with_previous(posts, "post_id")
    every = [p for ps in topics.values() for p in ps]
    for top_k in (None, 1, 7):
        seeds = rnd.sample(every, 6) + ["missing"]
        rnd.shuffle(seeds)
        rows = spark.createDataFrame(list(zip(seeds, range(len(seeds)))), "post_id string, seed_rank long")
        got = [r["post_id"] for r in threads.expand(placed, rows, 1, 2, top_k).orderBy("rank").collect()]
        assert got == plain_expand(topics, seeds, 1, 2, top_k)


def test_order_ties_and_missing_numbers(spark):
    posts = spark.createDataFrame([("t", "b", None, "2"), ("t", "a", 0, "2"), ("t", "c", 0, "1"), ("t", "d", 1, "0")], "topic_id string, post_id string, post_number int, posted_at string")
    got = threads.with_previous(posts, "post_id").orderBy("position").collect()
    assert [r["post_id"] for r in got] == ["c", "a", "b", "d"] and [r["previous"] and r["previous"]["post_id"] for r in got] == [None, "c", "a", "b"]


def test_aliases_and_running_numbers(spark):
    rows = spark.createDataFrame([("x", 5), ("y", 2), ("x", 9), ("z", 100000)], "s string, o long")
    assert {r["s"]: r["alias"] for r in threads.aliases(rows, "s", "o").collect()} == {"y": "participant_0001", "x": "participant_0002", "z": "participant_0003"}
    stored = spark.createDataFrame([("t", 4), ("t", 7)], "topic_id string, post_number int")
    new = spark.createDataFrame([("t", "b"), ("t", "a"), ("u", "c")], "topic_id string, post_id string")
    assert {r["post_id"]: r["post_number"] for r in threads.continued(new, stored, "topic_id", ["post_id"]).collect()} == {"a": 8, "b": 9, "c": 1}


def test_window_documents(spark):
    t = datetime(2024, 5, 1, 10)
    rows = [("c", 2, "m2", t + timedelta(minutes=1), "b", "two", 1), ("c", 1, "m1", t, "a", "one", 1), ("c", 3, "m3", t + timedelta(hours=1, microseconds=5), "a", "x", 2)]
    df = spark.createDataFrame(rows, "chat string, ordinal long, id string, timestamp timestamp_ntz, sender string, text string, window_no int")
    first, second = threads.window_documents(df).orderBy("window_no").collect()
    assert first["text"] == "[2024-05-01T10:00:00] a: one\n[2024-05-01T10:01:00] b: two" and first["message_ids"] == ["m1", "m2"] and first["participants"] == ["a", "b"]
    assert second["name"] == "c/2024-05-01/window-00002" and second["start_time"] == "2024-05-01T11:00:00.000005"
