"""A block list of junk hosts and paths by category, as pattern rules.

A rule has one word as its literal and fits where that word stands beside one of its
companions, in either order and joined by a hyphen, as a whole name of the host; the
rules for paths fit whole names of the path. Words that mean nothing else need no
companion. Other names, such as ``education-ads`` or ``adult-education``, are left alone.
"""

from __future__ import annotations

from tidegrid.llm.url_rules import PatternRule

# Words by category, with the companions that make a name junk.
HOST_PAIRS = {
    "spam": {
        "spam": "farm mail bot blast", "link": "farm wheel swap", "seo": "boost cheap links rank", "traffic": "bot exchange fake",
        "followers": "buy cheap free", "replica": "watches bags shop", "loan": "payday instant quick", "prize": "winner claim free",
    },
    "pharmacy": {
        "pills": "cheap diet online buy", "pharmacy": "cheap online discount rx", "meds": "cheap online discount",
        "steroids": "buy online cheap", "painkillers": "buy online cheap",
    },
    "gambling": {
        "casino": "win online bonus royal live best vip", "bets": "free best sport live sure", "poker": "online win free room",
        "slots": "free online win lucky", "roulette": "online live win", "jackpot": "win mega online", "lottery": "win online lucky",
        "betting": "sport online tips live",
    },
    "adult": {
        "adult": "x xxx cam cams video chat dating", "xxx": "cams video tube porn", "cams": "live sex nude", "sex": "chat live tube video",
        "escort": "girls city vip", "nude": "girls live photos",
    },
    "ads": {
        "ads": "track tracker server serve click pop", "ad": "track tracker server click", "banner": "click exchange server",
        "click": "bank pay track", "pixel": "track tracker", "affiliate": "track links click", "popup": "ads server",
    },
    "malware": {
        "warez": "free download full", "crack": "keygen serial download", "torrent": "free movies", "keygen": "free serial",
        "login": "secure-bank verify-account",
    },
}
HOST_WORDS = {
    "pharmacy": "viagra cialis tramadol", "gambling": "sportsbook onlinecasino", "adult": "porn hentai xvideos",
    "ads": "adserver doubleclick popunder clickbank", "malware": "phishing malware keylogger",
}
PATH_PAIRS = {
    "spam": {"spam": "farm", "loan": "payday"}, "pharmacy": {"pills": "cheap diet", "viagra": "cheap buy"},
    "gambling": {"casino": "online win", "poker": "online"}, "adult": {"cams": "xxx live", "porn": "free"},
}


def _pair(word: str, companions: str) -> str:
    others = "|".join(companions.split())
    return f"({word}-({others})|({others})-{word})"


def _host(names: str) -> str:
    return rf"^([^/?#]*[.-])?{names}([.:\n-][^/?#]*)?([/?#]|$)"


def _path(names: str) -> str:
    return rf"^[^/?#]*/([^?#]*[./-])?{names}([./?#\n-]|$)"


def junk_rules() -> tuple[PatternRule, ...]:
    """All rules of the list, each under a name of its own."""
    rules = [
        PatternRule(f"{category}/{where}/{word}", "block", build(_pair(word, companions)), (word,))
        for where, build, pairs in (("host", _host, HOST_PAIRS), ("path", _path, PATH_PAIRS))
        for category, words in pairs.items()
        for word, companions in words.items()
    ]
    return (*rules, *[
        PatternRule(f"{category}/host/{word}", "block", _host(f"({word})"), (word,))
        for category, words in HOST_WORDS.items()
        for word in words.split()
    ])
