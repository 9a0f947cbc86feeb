import json
import zipfile

import pytest

from sparkrag import sinks
from sparkrag.config import Settings
from sparkrag.sources import chat, evalsets, files, forum, wiki

POST = {"topic_id": "7", "topic_title": "Noise", "topic_url": "http://x/t/7", "post_id": "a", "post_url": "http://x/t/7#a", "author": "Ann", "posted_at": "2024-01-01T00:00:00Z", "page_number": 1, "post_number": 1, "text": " It rattles. "}
EXPORT = (
    "before the first header\n"
    "[1/2/24, 9:05:01 PM] ~ Ann Example: hello\nsecond line\n"
    "‎[1/2/24, 9:06:00 PM] ~ Ann Example: ‎image omitted\n"
    "[1/2/24, 9:07:00 PM] Bo Other joined\nnot a message\n"
    "[01/02/2024, 21:08] Bo Other: ask Ann Example at ann@b.com or +44 7700 900123\n"
    "[01/02/2024, 21:09] Bo Other: This message was deleted by admin Ann\n"
)


def lines(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows) + "\n", encoding="utf-8")
    return str(path)


def test_forum_posts(spark, tmp_path):
    good = lines(tmp_path / "a.forum.jsonl", [POST, "", POST | {"post_id": "b", "text": "two"}])
    assert forum.load_posts(spark, good).count() == 2
    docs = forum.load_documents(spark, good).orderBy("doc_id").collect()
    assert docs[0]["text"] == "Topic: Noise\n\nIt rattles." and docs[0]["metadata"]["source_url"] == "http://x/t/7#a" and docs[0]["doc_id"] == "forum:7:a"
    ids, most = forum.resume_state(forum.load_posts(spark, good))
    assert ids.count() == 2 and most.first()["post_number"] == 1
    for name, rows, says in (("bad", [POST, "{oops"], r"invalid JSON on .*bad.jsonl:2"), ("gap", [POST, "", POST | {"post_id": "c", "text": " "}], r"missing text on .*gap.jsonl:3"), ("null", [POST | {"topic_title": None}], "missing topic_title")):
        with pytest.raises(Exception, match=says) as e:
            forum.load_posts(spark, lines(tmp_path / f"{name}.jsonl", rows)).collect()
        assert "rattles" not in str(e.value).split("JVM stacktrace")[0]
    with pytest.raises(ValueError, match="duplicate post_id"):
        forum.load_posts(spark, lines(tmp_path / "twice.jsonl", [POST, POST]))


def test_forum_html():
    html = "<h1> A topic </h1><article id='elComment_5'><h3><a href='http://x/profile/1'>Ann</a></h3><time datetime='2024-01-01T00:00:00Z'>x</time><div class='ipsRichText ipsRichText--user'><p>one  two</p><blockquote>quoted <p>deep</p></blockquote><script>x</script><p>three</p></div></article><article id='elComment_6'><div class='ipsRichText--user'><div class='ipsQuote'>q</div></div></article>"
    assert forum.page_posts(html) == [{"topic_title": "A topic", "post_id": "5", "author": "Ann", "posted_at": "2024-01-01T00:00:00Z", "text": "one twothree"}]
    assert forum.page_posts(None) == []


def test_chat_export(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "chat.zip", "w") as z:
        z.writestr("_chat.txt", "﻿" + EXPORT)
        z.writestr("photo.jpg", b"x")
    raw = chat.read_archives(spark, str(tmp_path / "chat.zip"))
    parsed = chat.parse_messages(raw).orderBy("ordinal").collect()
    assert [(r["sender"], r["text"]) for r in parsed][:2] == [("~ Ann Example", "hello\nsecond line"), ("~ Ann Example", "‎image omitted")] and len(parsed) == 4
    assert [str(r["timestamp"]) for r in parsed] == ["2024-02-01 21:05:01", "2024-02-01 21:06:00", "2024-02-01 21:08:00", "2024-02-01 21:09:00"]
    kept, report = chat.prepare(chat.parse_messages(raw), "club")
    rows = kept.orderBy("ordinal").collect()
    assert [(r["id"], r["sender"], r["text"]) for r in rows] == [("msg_000001", "participant_0001", "hello\nsecond line"), ("msg_000003", "participant_0002", "ask [PERSON] at [EMAIL] or [PHONE]")]
    r = report.first()
    assert (r["parsed_messages"], r["written_messages"], r["participants"], r["skipped_deleted"], r["skipped_empty"], r["first_timestamp"]) == (4, 2, 2, 1, 1, "2024-02-01T21:05:01")
    path = lines(tmp_path / "club.chat.jsonl", [json.loads(x) for x in kept.orderBy("ordinal").drop("ordinal").toJSON().collect()])
    doc = chat.load_windows(spark, path).collect()
    assert len(doc) == 1 and doc[0]["doc_id"] == "club/2024-02-01/window-00001" and doc[0]["metadata"]["participants"] == "participant_0001,participant_0002"
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.jpg", b"x")
    with pytest.raises(Exception, match="expected one .txt member"):
        chat.read_archives(spark, str(tmp_path / "none.zip")).collect()
    bad = spark.createDataFrame([("p", "[99/99/24, 25:99] A: x")], "path string, text string")
    with pytest.raises(Exception, match="unsupported chat timestamp"):
        chat.parse_messages(bad).collect()


WIKI = """<div class="x">outside</div><div class="mw-parser-output"><table class="infobox"><tr><th>Class</th><td>Car<ul><li>no repeat</li></ul></td></tr><tr><td></td></tr></table>
<p>Lead  text{{cite}} <sup class="reference">[1]</sup>here.</p><h2>History<span class="mw-editsection">[edit]</span></h2><p>Old.</p><h4>Deep [edit]</h4><ul><li>one</li><li>two<ul><li>in</li></ul></li></ul>
<h2>Sources</h2><p>gone</p><h3>Below</h3><p>gone too</p><div class="navbox"><p>gone</p></div><h2>Later</h2><ol><li>last</li></ol></div>"""


def test_wiki_sections(spark, tmp_path):
    assert wiki.sections(WIKI) == [
        {"title": "Lead", "text": "Class | Car no repeat\nLead text here."}, {"title": "History", "text": "Old."},
        {"title": "History > Deep", "text": "- one\n- two in"}, {"title": "Later", "text": "- last"},
    ]
    pages = spark.createDataFrame([(1, WIKI), (2, None)], "page_id long, html string")
    assert wiki.without_excluded(wiki.html_sections(pages)).count() == 4


def test_wiki_documents_and_manifest(spark, tmp_path):
    article = {"title": "Golf", "requested_title": "Golf", "page_id": 5, "revision_id": 9, "source_url": "http://w/Golf", "sections": [{"title": " ", "text": "Lead."}, {"title": "Empty", "text": " "}, {"title": "History", "text": "Old."}]}
    path = lines(tmp_path / "a.wiki.jsonl", [article])
    docs = wiki.load_documents(spark, path).orderBy("doc_id").collect()
    assert [(d["doc_id"], d["text"]) for d in docs] == [("wikipedia:5:9:0", "Article: Golf\nSection: Lead\n\nLead."), ("wikipedia:5:9:2", "Article: Golf\nSection: History\n\nOld.")]
    assert docs[0]["metadata"]["license"] == "CC BY-SA 4.0" and docs[0]["metadata"]["language"] == "en"
    with pytest.raises(Exception, match="missing title, source_url or sections"):
        wiki.load_documents(spark, lines(tmp_path / "bad.jsonl", [article | {"sections": None}])).collect()
    for n, (pages, fine) in enumerate(((["A", "B"], True), ([], False), (["A", " "], False), (["A", "A"], False))):
        (tmp_path / f"m{n}.json").write_text(json.dumps({"pages": pages}))
        if fine:
            assert wiki.load_manifest(spark, str(tmp_path / f"m{n}.json"), 1).count() == 1
        else:
            with pytest.raises(ValueError):
                wiki.load_manifest(spark, str(tmp_path / f"m{n}.json"))


def test_fetch_waits_and_tries_again():
    waits, answers = [], [(429, {"Retry-After": "3"}, ""), (503, {}, ""), (200, {}, json.dumps({"parse": {"title": "x"}}))]
    assert wiki.fetch(lambda params: answers.pop(0), "x", sleep=waits.append) == {"title": "x"} and waits == [3.0, 2.0]
    with pytest.raises(RuntimeError, match="status 429"):
        wiki.fetch(lambda params: (429, {}, ""), "x", most=1, sleep=waits.append)


def test_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_documents(spark, str(tmp_path / "none"))
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "x.jpg").write_bytes(b"x")
    with pytest.raises(ValueError):
        files.load_documents(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "sub" / "A.MD").write_text("plain text")
    lines(tmp_path / "d" / "p.forum.jsonl", [POST])
    lines(tmp_path / "d" / "c.whatsapp.jsonl", [{"id": "m", "chat": "c", "timestamp": "2024-01-01T00:00:00", "sender": "p", "text": "t"}])
    lines(tmp_path / "d" / "w.wikipedia.jsonl", [{"title": "T", "source_url": "u", "page_id": 1, "revision_id": 2, "sections": [{"title": "S", "text": "x"}]}])
    docs = files.load_documents(spark, str(tmp_path / "d")).collect()
    assert sorted(d["source_type"] for d in docs) == ["chat", "file", "forum", "wiki"]


def test_eval_sets(spark, tmp_path):
    def load(queries, labels="relevant_post_ids"):
        (tmp_path / "q.json").write_text(json.dumps({"queries": queries}))
        return evalsets.load(spark, str(tmp_path / "q.json"), labels)

    one = {"id": 1, "question": "why", "relevant_post_ids": [5, 6]}
    assert load([one]).first()["labels"] == ["5", "6"]
    assert load([{"q": "why", "source": "a.md"}], "source").first()["query_id"] == "0"
    for bad in ([], [one, one], [one | {"question": ""}], [one | {"relevant_post_ids": []}]):
        with pytest.raises(ValueError):
            load(bad)


def test_settings(monkeypatch):
    monkeypatch.setenv("SPARKRAG_TOP_K", "9")
    monkeypatch.setenv("SPARKRAG_RERANK", "true")
    s = Settings.load(index_type="ivf")
    assert (s.top_k, s.rerank, s.index_type, s.candidate_k) == (9, True, "ivf", 20)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "post_id string, n int")
    assert sinks.append_new(rows, path, "post_id") == 2 and sinks.append_new(rows, path, "post_id") == 0
    sinks.swap(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    sinks.write_state(spark, str(tmp_path / "s.json"), {"done": [1], "name": "é"})
    assert sinks.read_state(spark, str(tmp_path / "s.json")) == {"done": [1], "name": "é"} and sinks.read_state(spark, str(tmp_path / "no.json")) == {}
    sinks.write_jsonl(spark.createDataFrame([("é", None)], "t string, n int"), str(tmp_path / "j"), "t")
    assert any('"t":"é"' in f.read_text(encoding="utf-8") for f in (tmp_path / "j").glob("part-*"))
