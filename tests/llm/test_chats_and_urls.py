"""Chat formatting and URL rules against plain Python."""

import random
import re

import pytest

from tidegrid.llm import chat, url_rules
from tidegrid.llm.queries import PATTERN_RULES, SITE_RULES
from tidegrid.llm.url_lists import HOST_PAIRS, PATH_PAIRS

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, loss_spans string, turns int, pieces int"
PIECES = ["</s>", "[INST]", "[/INST]", "[TURN]", "<s>", "\\", "\\0", "\\1", "é漢👍", " ", "\n", "ok", ""]


def conversations():
    rng = random.Random(4)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a<b", None])
            text = rng.choice([None, "".join(rng.choice(PIECES) for _ in range(8))])
            rows.append((conv, rng.choice([turn, turn, 3, None]), role, text))
    rows += [(50, 0, "user", "twice")] * 2 + [(51, k, "assistant" if k % 3 else "user", f"t{k}\\") for k in range(2_500)]
    return rows


def brute(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))] for c, v in out.items()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in conversations()], SCHEMA).repartition(3)


def test_round_trip_and_mask(rows):
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(rows)).collect()}
    want = brute(conversations())
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.loss_text == "".join(t for role, t in want[c] if role == "assistant")
        raw = r.formatted.encode()
        assert all(raw[s.start + s.length :].startswith((b"</s>", b"[TURN]")) for s in r.loss_spans)


def test_control_strings_occur_only_as_such(rows):
    for r in chat.format_chats(rows).collect():
        plain = re.sub(r"<s>\[INST\]|\[/INST\]|\[TURN\]|</s>", "", r.formatted)
        assert not re.search(r"[<\[]", plain)


def test_adjacent_turns_of_a_role_are_one_message(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "user", "c"), (1, 1, "user", "b"), (1, 3, "assistant", "d")],
                                 "conv_id long, turn long, role string, text string")
    assert chat.format_chats(rows).first().formatted == "<s>[INST]user[/INST]a[TURN]b[TURN]c</s><s>[INST]assistant[/INST]d</s>"


def test_template_and_empty_table(spark):
    with pytest.raises(ValueError):
        chat.Template(begin="x")
    other = chat.Template("<a>", "[b]", "[c]", "<d>", "[e]", trained=("user",))
    rows = spark.createDataFrame([(1, 0, "user", "[e]")], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(rows, other), other).first().loss_text == "[e]"
    assert chat.read_chats(chat.format_chats(rows.where("false"))).count() == 0


URLS = [
    None, "", "no scheme/en/1", "http://", "://", "http://ORG", "http://org/x", "https://a.Example.org/es/1?q=/de/", "http://example.org/en/1",
    "http://example.org/en/19", "http://example.org/EN/1", "http://myexample.org/es/", "http://example.organic/es/", "http://a.com/fr/x", "http://a.com/de/",
    "http://a.com/de", "http://a.com?x=/de/", "http://a.com#/fr/", "ftp://u:p@b.com:80/de/x#y", "http://spam-farm.example.net/en/2",
    "http://x.net/a/cheap-pills/1", "http://x.net/cheappills", "http://x.net/xcheap-pillsx", "http://spam-farm.com/fr/1", "a://b://c.com/de/",
    "http://x.net/farm/spam", "http://ÉX.com/de/é", "http://a.com/de/\nx",
]


def verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in SITE_RULES if (low == r.host or low.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.host + r.path))
        return low, path, best.host + best.path, best.action
    blocked = any(re.search(r.regex, low + rest[len(host) :]) for r in PATTERN_RULES)
    return low, path, None, "block" if blocked else "allow"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_verdicts(spark, by_id, monkeypatch, limit):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", limit)
    rows = [(k, u, "x", 1, "t", "r") for k, u in enumerate([*URLS, *URLS[5:9]])] + [(None, URLS[8], "x", 1, "t", "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int, token string, target string")
    got = url_rules.judge_urls(pages, (*SITE_RULES, *PATTERN_RULES))
    assert by_id(got.drop("pattern").collect()) == by_id((r[0], *verdict(r[1])) for r in rows)
    assert url_rules.judge_urls(pages.where("false"), SITE_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://spam.example.org/{k}",) for k in range(5)] + [("http://farm.x/",)], "url string")
    urls = urls.selectExpr("url", "substr(url, 8) AS target")
    farm = url_rules.PatternRule("spam-farm", "block", "spam-farm", ("spam", "farm"))
    rules = [farm, SITE_RULES[1], url_rules.PatternRule("any", "block", "zzz+")]
    got = {r.rule: r.token for r in url_rules.rule_index(urls, rules).collect()}
    assert got == {"spam-farm": "farm", "example.org/es/": "es", "any": ""}


@pytest.mark.parametrize("junk", [True, False])
def test_junk_list(spark, junk):
    """Planted names of each category are blocked; names that only hold such words are left alone."""
    blocked = [
        "http://m.casino-win.example.com/en/1", "http://free-bets.example.com:80", "https://m.ads-track.example.com?x", "http://blog.adult-x.example.net/",
        "http://www.spam-farm.example.com/de", "http://WWW.cheap-pills.example.com/a", "http://x.net/a/xxx-cams.html", "http://best-viagra.biz/",
        "http://a.adserver.net/p.gif", "http://win-big.online-poker.io",
    ]
    left = [
        "http://adult-education.example.com/", "http://casino.example.com/", "http://a.com/casinowin", "http://myspam-farms.org", "http://education-ads.com/",
        "http://a.com/?q=spam-farm", "http://sex-education.org/en/", "http://trackads.com/", "http://pills.example.com/cheap", "http://a.com/en/spam-farmers",
    ]
    urls = blocked if junk else left
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, PATTERN_RULES).collect()}
    assert [u for k, u in enumerate(urls) if (got[k] == "block") != junk] == []


def test_every_rule_holds_its_literal():
    """A rule's literals are tokens of each name that it fits, and names of rules differ."""
    assert len(PATTERN_RULES) > 50 and len({r.rule for r in PATTERN_RULES}) == len(PATTERN_RULES)
    for rule in PATTERN_RULES:
        (word,) = rule.literals
        category, where, _ = rule.rule.split("/")
        pairs = (HOST_PAIRS if where == "host" else PATH_PAIRS).get(category, {}).get(word, "")
        names = [n for c in pairs.split() for n in (f"{word}-{c}", f"{c}-{word}")] or [word]
        for name in names:
            target = f"{name}.example.org/" if where == "host" else f"example.org/{name}/"
            assert re.search(rule.regex, target) and word in url_rules.tokens_of(target)


def test_only_candidates_run_their_pattern(spark):
    """The pattern is a filter above the join on the token, and no Python runs."""
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    plan = url_rules.judge_urls(pages, SITE_RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "Python" not in plan and "Cartesian" not in plan


def test_actions_are_checked(spark):
    with pytest.raises(ValueError):
        url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), [url_rules.SiteRule("drop", "a", "/")])
