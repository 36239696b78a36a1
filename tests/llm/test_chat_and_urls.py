"""Chat formatting round trips and URL verdicts on odd rows."""
import hashlib

import numpy as np
import pytest

from tsq.llm import chat as C
from tsq.llm import urls as U
from tsq.session import scratch_path

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] [SYS][/ROLE]", "Ünï 中文 😀\r\n\t ", "<<s>> [[INST]]", "<|endoftext|>", "ab" * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_escape_and_turn_round_trip(text):
    assert C.unescape(C.escape(text)) == text
    assert not any(m in C.escape(text) for m in C.MARKS)
    for role in ("user", "assistant", "system", "", "tool [/ROLE]"):
        ids, mask = C.format_turn(role, text)
        assert C.read_turn(ids, mask) == (role, text, text if role == "assistant" else "", len(C.render(ids)))
        assert (ids[mask] < C.FIRST_MARK).all() and C.escape(text) in C.render(ids) and C.render(ids).startswith("<s>")


def test_ids_are_those_of_the_whole_text():
    whole = C.encoding().encode_ordinary
    for text in ("ab" * 100_000, "the quick brown fox, 12 times. " * 6000, "é" * 90_000 + " x", "word " * 30_000 + "\n\n" + " " * 9_000 + "end"):
        assert C.encode_text(text) == whole(text)
    for run in (" ", "\n", " \n\t", "\u3000"):
        for text in (f"a{run * 12_000}b", f"a{run * 12_000}", f"{run * 12_000}b c{run * 11_000} d"):
            assert C.encode_text(text) == whole(text)
    huge = "x" + " " * 1_000_000 + "y"  # the library alone can't take this
    assert C.encoding().decode(C.encode_text(huge)) == huge


def test_conversations(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b </s>"), (2, 0, "assistant", None), (2, 0, "assistant", None),
            (3, None, "user", "first"), (3, 1, None, "x"), (None, 0, "user", "n"), (None, 1, "assistant", "o"), (4, 0, "system", "s")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"t{i} " * 9) for i in range(25_000)]
    d = spark.createDataFrame([(9, *r) for r in rows], "ids int, conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "t10")
    C.write_chats(d, path)
    got = {r.conv_id: r for r in C.read_chats(spark, path).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine)
        said = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert all(r.formatted_chars > r.loss_chars for r in got.values())
    turns = C.read_turns(spark, path).where("conv_id = 1").orderBy("turn").collect()
    assert [(r.role, r.text, r.loss, r.chars) for r in turns] == [
        ("user", "a", "", len("<s>[INST]a[/INST]")), ("assistant", "b </s>", None, len("<s>b <\\/s></s>")), ("user", "c", "", len("<s>[INST]c[/INST]"))]
    empty = scratch_path(spark, "t10")
    C.write_chats(d.limit(0), empty)
    assert C.read_chats(spark, empty).count() == 0


URLS = [(1, "HTTP://A.Example.NET/en/x?q"), (2, "http://example.net"), (3, "https://x.example.com/de/1#y"), (4, None), (5, "no scheme"),
        (6, "ftp://my.org/fr/a"), (7, "http://netx/"), (8, "http://foo.net/a b"), (9, "://"), (10, "http://h://p?x://y"), (1, "http://x.org/fr/"),
        (None, "http://É.Org/fr/é"), (11, "http://net/" + "z" * 5000), (12, "http://neutral.example/en/1")]


def test_rules_and_parts(spark):
    d = spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, said string")
    got = [(r.page_id, r.host, r.path, r.rule) for r in U.judge_urls(d).collect()]
    want = [(1, "a.example.net", "/en/x", "example.net/en/"), (2, "example.net", "", None), (3, "x.example.com", "/de/1", "example.com/de/"),
            (4, "", "", None), (5, "", "", None), (6, "my.org", "/fr/a", "org/fr/"), (7, "netx", "/", None), (8, "foo.net", "/a b", "net/"),
            (9, "", "", None), (10, "h:", "//p", None), (1, "x.org", "/fr/", "org/fr/"), (None, "É.org", "/fr/é", "org/fr/"),
            (11, "net", "/" + "z" * 5000, "net/"), (12, "neutral.example", "/en/1", None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_verdicts_follow_the_learning_urls(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        good = bool(rng.integers(2))
        word = "".join(rng.choice(list("abcd" if good else "wxyz"), 8))
        host = ("x.org" if good else "x.net") if i % 2 else "x.test"
        rows.append((i, f"http://{host}/fr/{word}", good))
    d = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(d).collect()}
    assert np.mean([(got[i] == "allow") == good for i, _, good in rows]) > 0.97
    none = spark.createDataFrame([(1, "http://x.test/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(none).collect()} == {"allow"} and U.judge_urls(none.limit(0)).count() == 0


def test_url_plan_runs_no_python(spark):
    d = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    plan = U.judge_urls(d)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_url_joins_are_merge_joins(spark, monkeypatch):
    """n-grams exploded from small rows are estimated as small: never broadcast."""
    plans, real = [], U.stored
    monkeypatch.setattr(U, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    d = spark.createDataFrame([(i, f"http://x{i}.{('net', 'org', 'test')[i % 3]}/fr/{i}") for i in range(60)] + [(60, None)], "page_id long, url string")
    out = U.judge_urls(d)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plans[-1] and "SortMergeJoin" in plans[-2] and not any("BroadcastHashJoin" in p for p in plans)
    assert out.count() == 61
