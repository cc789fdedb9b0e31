"""Rule tables: categories, phrases, keyword weights and thresholds.

All values in this module are FIXED VALUES: they have to equal the published
defaults for the results to agree.  ``RulePack`` bundles them and can be loaded
from user files instead.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

# --- fixed values: categories -------------------------------------------------
CATEGORIES = ["loading", "Help", "Feature Buy", "BigWin", "Transition",
              "Feature game", "Result", "Basegame", "Other"]
AUX_SCORES = ["BasegameUI", "FeatureUI", "FeatureBoard", "FeatureActive",
              "HelpPaytable", "HelpQuality", "FeatureObstruction", "BigWinKeep"]
SUMMARY_CATEGORIES = ["loading", "Basegame", "Transition", "Feature game",
                      "Feature Buy", "BigWin", "Result", "Help"]

# --- fixed values: thresholds -------------------------------------------------
MIN_TEXT_SCORE = 0.6
MIN_CATEGORY_SCORE = 3.0
FRAME_INTERVAL = 20
DENSE_STEP = 10
DIFF_THRESHOLD = 15.0
FORCE_EVERY = 120
DENSE_AFTER = {"Help": 260, "Transition": 90, "Feature game": 180}
BLUR_MIN = 45.0
EXPOSURE_MAX = 4.0
EXPOSURE_DENSE_EXTRA = 2.0
NOISE_MAX = 3.4
NOISE_UI_MARGIN = 2.0
BASEGAME_UI_MIN = 2.5
BASEGAME_UI_KEEP = 3.0
FEATURE_UI_KEEP = 3.5
FEATURE_ACTIVE_KEEP = 8.0
OBSTRUCTION_MAX = 2.8
BIGWIN_KEEP_MIN = 10.0
HELP_QUALITY_MIN = 8.0
HELP_RULE_QUALITY_MIN = 2.5
EVENT_GAP = {"Transition": 600, "BigWin": 600, "Help": 360}
TOP_K = {"Transition": 6, "Result": 6, "loading": 6, "BigWin": 12, "Help": 160, "Feature Buy": 6}
TOP_K_DEFAULT = 10

# --- fixed values: word corrections (wrong reading -> right reading) -----------
WORD_CORRECTIONS = {
    "megawin": "mega win", "megawi": "mega win", "megawis": "mega win", "megawiy": "mega win",
    "megawilg": "mega win", "megawily": "mega win", "megawil": "mega win", "megawil}": "mega win",
    "megw": "mega", "mecawin": "mega win", "meca": "mega", "biswin": "big win",
    "bigwin": "big win", "superwin": "super win", "superiwin": "super win", "superi": "super",
    "jumbowin": "jumbo win", "jumbown": "jumbo win", "jumboloin": "jumbo win", "jumbo": "jumbo",
    "loin": "win", "congradulations": "congratulations", "congradulation": "congratulations",
    "hugewin": "huge win", "massivewin": "massive win", "epicwin": "epic win",
    "egawint": "mega win", "egawin": "mega win", "egawink": "mega win", "legawink": "mega win",
    "legawint": "mega win", "legawin": "mega win", "jegawin": "mega win", "auper": "super",
    "aupen": "super", "huper": "super", "nuper": "super", "guper": "super", "sunen": "super",
    "espins": "spins", "snin": "spin", "snind": "spin", "snins": "spins",
    "freesnins": "free spins", "freespinsd": "free spins", "tree": "free",
    "treesnin": "free spin", "treesnind": "free spin", "freespil": "free spin",
    "iofregspins": "10 free spins", "respi": "respin", "freespins": "free spins",
    "freespin": "free spin", "lastfreespins": "last free spins",
    "lastfreespin": "last free spin", "remainn": "remaining", "feafures": "features",
    "fransforms": "transforms", "info": "into", "stant": "start", "cotal": "total",
    "rotal": "total", "colal": "total", "x1o": "x10",
}

# --- fixed values: keyword weights per category, in category order --------------
KEYWORD_WEIGHTS = {
    "loading": {"loading resource": 8, "loading": 7, "please wait": 6, "wait": 1},
    "BigWin": {
        "sensational": 8, "super mega win": 8, "super megawin": 8, "big win": 6, "bigwin": 6,
        "bis win": 6, "mega win": 5, "megawin": 5, "meca win": 5, "mega wi": 5, "super win": 5,
        "superwin": 5, "superi win": 5, "jumbo win": 5, "jumbowin": 5, "jumbown": 5,
        "jumbo loin": 5, "huge win": 5, "hugewin": 5, "massive win": 4, "massivewin": 4,
        "epic win": 4, "epicwin": 4, "amazing win": 3, "great win": 3, "awesome win": 3,
        "win big": 5, "winner": 1,
    },
    "Transition": {
        "congratulations": 8, "congradulations": 8, "you have won": 8, "start button": 12,
        "press start": 12, "tap to start": 12, "click to start": 12, "continue": 5,
        "confirm": 5, "next": 5, "skip": 5, "enter free game": 4, "begin": 3, "start": 2,
        "go": 1, "press": 1, "tap": 1, "click": 1,
    },
    "Feature game": {
        "remaining free spins": 18, "free spins remaining": 18, "remaining free spin": 18,
        "free spins left": 18, "free spin left": 18, "spin remaining": 14,
        "spins remaining": 14, "free spin mode": 10, "free spins intro": 8, "respin": 4,
        "extra spins": 4, "extra spin": 4, "free spins": 3, "free spin": 2, "freespins": 2,
        "freespin": 2, "bonus round": 3, "bonus game": 3, "free game": 3, "free games": 3,
        "feature activated": 2, "features activated": 2, "all features activated": 2,
        "all features are activated": 2, "super bonus": 3, "bonus": 1,
    },
    "Feature Buy": {
        "buy super free spins": 12, "buy free spins": 12, "buy super free spin": 12,
        "buy free spin": 12, "feature buy": 10, "buy feature": 10, "super feature buy": 10,
        "buy bonus": 8, "cost": 5, "bet": 3, "quantity": 4, "select start": 6,
        "current cost": 4, "current bet": 4, "cancel": 3, "buy": 3,
    },
    "Help": {
        "paytable": 12, "pay table": 12, "symbol payout values": 12, "symbol payout": 10,
        "payout values": 8, "game rules": 10, "rules": 6, "how to play": 8, "help": 6,
        "wild symbol": 6, "scatter symbol": 6, "during any spins": 6, "during any spin": 6,
        "reels": 3, "symbols": 3, "ways": 3, "occupy": 3, "payout": 3,
    },
    "Result": {
        "total win": 10, "you've won": 10, "youve won": 10, "you won": 10, "collect": 10,
        "reward": 3, "payout": 4, "congratulations": 4, "congrats": 4, "game over": 4,
        "lose": 2, "lost": 2, "no win": 4, "score": 2, "total": 1,
    },
}
SCORED_CATEGORIES = list(KEYWORD_WEIGHTS)

# --- fixed values: phrase lists --------------------------------------------------
PHRASES = {
    "loading": ["loading resource", "loading", "please wait"],
    "vendor": ["pg soft", "pgsoft", "pocket games soft", "rights reserved", "licensed", "license",
               "certified", "mga", "bmm", "testlabs"],
    "marketing": ["featuring", "free spin", "free spins", "wild symbol", "wild symbols", "multiplier",
                  "multipliers", "loading game", "downloading"],
    "download": ["loading game", "downloading", "download over", "download over wi fi"],
    "gameplay": ["tap to shoot", "tap to pick", "pick", "choose", "reveal"],
    "cover_rules": ["paytable", "pay table", "payout values", "game rules", "how to play",
                    "during any spin", "during any spins", "scatter symbol", "reels"],
    "cover": ["chance to play", "chances to play", "chance top lay", "chances top lay",
              "chance toplay", "chances toplay", "every ball", "randomly awards", "random awards", "start"],
    "award": ["congratulations", "congrats", "you have won", "you won"],
    "free_spin": ["free spins", "free spin"],
    "free_spin_any": ["free spins", "free spin", "freespins", "freespin"],
    "action": ["start button", "press start", "tap to start", "click to start", "continue", "confirm",
               "next", "skip", "enter free game"],
    "start_action": ["press start", "tap to start", "click to start"],
    "feature_intro": ["you have won", "free spins won", "feature activated", "features activated",
                      "features are activated", "all features activated", "all features are activated",
                      "bonus game", "bonus round", "free game", "free games", "free spins", "free spin",
                      "transforms into", "is removed", "increase the total win multiplier",
                      "total win multiplier", "win with"],
    "remaining": ["remaining", "remains", "remain", "last", "left"],
    "free_play": ["free spin", "free spins", "free game", "free games"],
    "active": ["remaining free spins", "free spins remaining", "last free spin", "round", "rounds",
               "chance", "chances", "current multiplier", "multiplier", "tap to shoot", "tap to pick",
               "pick", "choose", "reveal", "spin the wheel", "wheel", "hold and win", "respin",
               "bonus game", "feature win", "win:"],
    "interaction": ["tap to shoot", "tap to pick", "pick", "choose", "reveal", "shoot",
                    "spin the wheel", "stop", "tap", "hold"],
    "feature_buy": ["feature buy", "buy feature", "super feature buy", "buy bonus", "buy free spins",
                    "buy free spin", "buy super free spins", "buy super free spin"],
    "purchase": ["cost", "current cost", "bet size", "bet level", "quantity", "select start", "click buy",
                 "trigger the free game", "trigger the free spins", "amount", "buy a free game",
                 "buy free game", "click buy to play", "with current cost", "buy free spins",
                 "buy super free spins", "buy free spin", "buy super free spin"],
    "buy_title": ["free spins", "free spin", "super free spins", "super free spin"],
    "help": ["paytable", "pay table", "symbol payout values", "symbol payout", "payout values",
             "game rules", "how to play", "wild symbol", "scatter symbol", "during any spins",
             "during any spin"],
    "overlay_ui": ["credit", "bet", "autoplay", "free spins left", "buy free spins"],
    "overlay_help": ["game rules", "paytable", "pay table", "symbol payout", "payout values",
                     "wild symbol", "scatter symbol", "page"],
    "overlay_ui_items": ["credit", "bet", "autoplay", "free spins left"],
    "overlay_help_items": ["game rules", "paytable", "page", "wild symbol", "scatter symbol"],
    "result": ["total win", "you've won", "youve won", "you won", "collect", "game over"],
    "win_multiplier": ["total win multiplier", "increase the total win multiplier", "win multiplier"],
    "won_or_collect": ["collect", "you won", "youve won", "you ve won"],
    "total_win": ["total win", "youve won", "you won", "you ve won"],
    "banner_block": ["total win", "collect", "you won", "youve won", "you ve won"],
    "bigwin": ["sensational", "big win", "bigwin", "mega win", "megawin", "super mega win",
               "super megawin", "super win", "superwin", "superi win", "jumbo win", "jumbowin",
               "jumbown", "jumbo loin", "huge win", "hugewin", "massive win", "massivewin", "epic win",
               "epicwin", "mega wi", "meca win", "bis win"],
    "modal": ["official and genuine", "genuine pg games", "verify exclusively", "transaction id",
              "dont show this again", "don t show this again", "accept", "ignore", "verification",
              "auto spin", "number of auto spins", "auto spins"],
    "modal_word": ["official", "genuine", "verify", "accept", "ignore", "transaction", "auto spin",
                   "auto spins", "number"],
    "jackpot": ["jackpot", "grand", "major", "minor", "mini"],
    "jackpot_pick": ["please select", "select one", "pick", "choose"],
    "control": ["turbo", "auto spin", "auto", "spin button", "press spin"],
    "control_word": ["turbo", "auto", "spin", "bet", "balance", "credit"],
    "money_word": ["balance", "credit", "bet"],
    "multiplier_intro": ["total win multiplier", "increase the total win multiplier", "win with"],
    "feature_terms": ["free spins", "free spin", "bonus", "activated", "features", "transforms into"],
    "rule_intro": ["multiplier increases", "after every win", "increase the total win multiplier", "win with"],
    "trigger_hint": ["triggers", "trigger", "feature buy"],
    "trigger_or_buy": ["triggers", "trigger", "feature buy", "buy feature"],
    "running_label": ["remaining free spins", "remaining free spin", "last free spin", "last free spins"],
    "free_game_text": ["free spins", "free spin", "last free spin", "last free spins",
                       "remaining free spin", "remaining free spins", "free spins won"],
    "running_or_won": ["last free spin", "last free spins", "remaining free spin",
                       "remaining free spins", "free spins won"],
    "transition_action_text": ["skip", "press", "continue", "confirm", "next", "accept", "ignore",
                               "press start", "tap to start", "click to start", "congratulations",
                               "you have won"],
    "buy_or_auto": ["buy feature", "feature buy", "auto", "turbo"],
    "start_overlay": ["start button", "press start", "tap to start", "click to start", "start"],
    "bigwin_other": ["free spins", "free spin", "feature buy", "start", "remaining free spin",
                     "remaining free spins", "last free spin", "last free spins", "free spins won",
                     "triggers", "trigger"],
    "result_keep": ["round", "chance", "tap", "multiplier"],
    "feature_words": ["remaining", "remaining free spin", "remaining free spins", "free spin remaining",
                      "free spins remaining", "last free spin", "last free spins", "free spins left",
                      "free game bonus"],
    "counter_block": ["congratulations", "you have won", "you won", "press", "continue", "start"],
    "start_intro": ["start", "starting", "press start", "tap to start", "click to start", "begin", "enter"],
    "base_words": ["balance", "total bets", "total bet", "extrabet", "extra bet", "bet", "auto",
                   "turbo", "spin"],
    "browser": ["home figma", "notion", "chatgpt", "gitlab", "google chrome", "chrome", "pragmatic play"],
    "browser_page": ["page", "game rules", "information screen", "symbol"],
    "award_words": ["you have won", "you won", "congratulations"],
    "settings_words": ["settings menu", "information screen", "game history", "skip screens option",
                       "auto skips"],
    "paytable_title": ["paytable", "pay table", "symbol payout values"],
    "quality_title": ["paytable", "pay table", "symbol payout values", "symbols pay anywhere", "symbols pay"],
    "table_terms": ["symbol", "wild", "scatter", "payout"],
    "wild_scatter": ["wild", "scatter"],
    "continuation": ["some symbols", "symbol during payout", "wild symbol", "wilds on the way",
                     "scatter symbol"],
    "quality_terms": ["paytable", "symbol", "symbols", "payout", "wild", "scatter", "during", "reels",
                      "ways", "winning", "occupy", "feature", "free spins", "multipliers", "line", "bet"],
    "explicit_remaining": ["remaining free spins", "remaining free spin", "free spins remaining",
                           "free spin remaining", "last free spins", "last free spin",
                           "free spins left", "free spin left"],
    "lower_terms": ["remaining", "remain", "remains", "last", "left", "free spin", "free spins"],
    "counter_words": ["remaining", "last", "left"],
    "buy_button": ["feature buy", "buy feature"],
    "buy_dialog": ["cost", "quantity", "cancel", "select start", "click buy", "trigger the free"],
    "auto_turbo": ["turbo", "auto"],
    "brand_block": ["balance", "total bets", "total bet", "ways", "free game", "free spin", "buy feature",
                    "feature buy", "paytable", "symbol", "wild", "scatter", "loading", "please wait",
                    "win", "bet", "auto", "turbo", "start"],
    "brand": ["entertain beyond boundaries", "beyond boundaries"],
    "legal": ["ver", "certified", "testlabs", "gaming", "institution", "regulations", "fair and just",
              "licensed", "license", "rights reserved", "pocket games soft", "pg soft", "omniplay",
              "omni play", "bmm", "mga", "ga "],
    "real_ui": ["balance", "total bets", "total bet", "buy feature", "feature buy", "remaining",
                "total win", "collect", "jackpot", "grand", "major", "minor", "mini", "please select"],
    "cover_like": ["get started", "win up to", "up to", "score a goal", "free games", "featuring",
                   "licensed", "rights reserved"],
    "cover_button": ["get started", "start game", "play now"],
    "balance_words": ["balance", "total bets", "total bet"],
}
# plain substring lists (no space-free form)
HELP_RULE_TERMS = ["symbol", "symbols", "wild", "scatter", "payout", "paytable", "reels", "ways",
                   "spins", "winning", "values", "occupy"]
RULES_PAGE_TERMS = ["paytable", "payout", "symbol", "symbols", "wild", "scatter", "paylines",
                    "game feature", "feature buy", "jackpot", "reels", "ways", "substitute", "trigger",
                    "multiplier", "free game", "free spins"]
GAME_RULES_TERMS = ["game rules", "tap to", "wallet balance", "bet amount", "auto spin", "turbo spin",
                    "more settings", "game history", "sound on", "sound off"]
PAYOUT_TITLE_TERMS = ["symbol payout", "payout values", "symbol pays", "symbol pay",
                      "symbols pay anywhere", "symbols pay", "same symbol"]
IGNORED_TITLE_WORDS = ["chatgpt", "gitlab", "demogame", "home", "figma", "notion", "loading", "game",
                       "pgsoft", "pocket", "games", "soft"]
PLAIN_TIERS = [("super mega win", "Super Mega Win"), ("jumbo win", "Jumbo Win"), ("super win", "Super Win"),
               ("mega win", "Mega Win"), ("big win", "Big Win"), ("huge win", "Huge Win"),
               ("massive win", "Massive Win"), ("epic win", "Epic Win")]

# --- fixed values: patterns ------------------------------------------------------
PATTERNS = {
    "feature_intro": [r"all\s*\d*\s*features?\s*(?:are\s*)?activated",
                      r"\d+\s*features?\s*(?:are\s*)?activated",
                      r"features?\s*(?:are\s*)?activated"],
    "running": [r"(remaining|remains|remain|last|left)\s+\d*\s*(free\s*)?spins?",
                r"free\s+spins?\s+\d*\s*(?:remaining|remains|remain|last|left)",
                r"remains?\s+until\s+end\s+of\s+free",
                r"last\s+free\s+spins?",
                r"free\s+spins?\s+left",
                r"free\s*(game|games)\s*\d{1,3}\s*/\s*\d{1,3}",
                r"\d{1,3}\s*/\s*\d{1,3}\s*free\s*(game|games)"],
    "running_compact": [r"free(game|games)\d{1,3}/\d{1,3}", r"free(game|games|spin|spins)\d{2,4}"],
    "cover": [r"\b\d+\s*chances?\s*to\s*play\b", r"\bchances?\s*to\s*play\b"],
    "cover_compact": [r"(congratulations|youhavewon|youwon)\d{1,3}freespins?", r"chancestoplay|chancestopay"],
    "bigwin_compact": [r"(big|mega|meca|super|superi|jumbo|jumbol|huge|massive|epic|egawi|legawi|jegawi|megawi)\w{0,6}(win|wim|wn)",
                       r"jumbo\w{0,4}(win|wim|wn|loin)",
                       r"megawi|egawink|legawint|legawin|jegawin"],
    "feature_text": [r"free\s*(game|spin|spins)\s*\d{1,3}\s*/\s*\d{1,3}",
                     r"free\s*(game|games|spin|spins)\s*\d{1,3}\s*(of|f)\s*\d{1,3}",
                     r"\d{1,3}\s*/\s*\d{1,3}\s*free\s*(game|spin|spins)"],
    "counter": [r"free\s*(game|spin|spins)\s*\d{1,3}\s*/\s*\d{1,3}",
                r"free\s*(game|games|spin|spins)\s*\d{1,3}\s*(of|f)\s*\d{1,3}",
                r"\d{1,3}\s*/\s*\d{1,3}\s*free\s*(game|spin|spins)",
                r"remaining\s*free\s*(spin|spins)\s*\d{1,3}",
                r"free\s*(spin|spins)\s*remaining\s*\d{1,3}"],
    "counter_of": [r"free(game|games|spin|spins)\d{1,3}(of|f)\d{1,3}"],
    "counter_compact": [r"free(game|games|spin|spins)\d{1,3}(of|f)\d{1,3}",
                        r"free(game|games|spin|spins)\d{1,3}/\d{1,3}",
                        r"free(game|games|spin|spins)\d{2,4}"],
    "short_number": [r"\b\d{1,3}\b"],
    "win_number": [r"\bwin\s+\d"],
    "times_number": [r"\bx\s*\d+(?:[.,]\d+)?\b"],
    "number_times": [r"\b\d+(?:[.,]\d+)?\s*x\b"],
    "win_colon": [r"\bwin\s*[::]\s*\d"],
    "fraction": [r"\b\d+\s*/\s*\d+\b"],
    "amount": [r"\b\d[\d,. ]{1,}\b"],
    "money": [r"\bb\d+(?:\s?\d{2,3})*(?:\.\d+)?\b"],
    "decimal": [r"\d+\.\d{2}"],
    "banner": [r"\bwin\s+\d+(?:\s?\d{2,3})*(?:\.\d+)?\b"],
    "big_amount": [r"\d[\d,. ]{2,}"],
    "payout_text": [r"\d[\d,. ]{3,}"],
    "left_number": [r"(remaining|remain|remains|last|left)\s+\d{1,3}\s*(free\s*)?spins?"],
    "number_left": [r"(free\s*)?spins?\s+\d{1,3}\s*(remaining|remain|remains|left)"],
    "free_start": [r"(free|feature|start)"],
    "tier_win": [r"(big|mega|huge|massive|epic|total).*win"],
}
# substrings of which every match of the patterns has one: searching them is cheaper than matching
PATTERN_NEEDS = {
    "feature_intro": ["activated"], "running": ["free", "spin"], "running_compact": ["free"], "cover": ["chance"],
    "cover_compact": ["freespin", "chancesto"], "bigwin_compact": ["wi", "wn", "loin"], "feature_text": ["free"], "counter": ["free"],
    "counter_of": ["free"], "counter_compact": ["free"], "win_number": ["win"], "times_number": ["x"], "number_times": ["x"],
    "win_colon": ["win"], "fraction": ["/"], "money": ["b"], "decimal": ["."], "banner": ["win"],
    "left_number": ["remain", "last", "left"], "number_left": ["spin"], "tier_win": ["win"],
}

# --- fixed values: big-win tiers ---------------------------------------------------
BIGWIN_TIERS = ["big_win", "super_win", "mega_win", "super_mega_win", "jumbo_win", "huge_win",
                "massive_win", "epic_win"]
BIGWIN_TIER_LABELS = {t: t.replace("_", " ").title() for t in BIGWIN_TIERS}
TIER_SUPER = ["super", "superi", "auper", "aupen", "huper"]
TIER_MEGA = ["mega", "me9a", "meca", "megawi", "megaw", "egawi", "legawi", "jegawi"]

# --- fixed values: feature subtypes, in choice order --------------------------------
FEATURE_SUBTYPES = {
    "free_spins_reels": ["remaining free spins", "free spins remaining", "last free spin",
                         "free spin mode", "free games", "free game"],
    "wheel": ["wheel", "spin the wheel", "wheel bonus", "pointer", "segment", "sectors"],
    "pick": ["pick", "choose", "reveal", "select", "mystery", "box", "chest", "card"],
    "minigame": ["tap to shoot", "shoot", "goal", "ball", "football", "round", "rounds", "chance",
                 "chances", "multiplier"],
    "hold_and_win": ["hold and win", "hold", "respin", "cash on reels", "collect", "lock"],
}
# --- end of fixed values -------------------------------------------------------------


def normalise_plain(text: str) -> str:
    """Driver-side normal form of a rule phrase, without word corrections."""
    return " ".join(re.findall(r"[a-z0-9]+", str(text).lower()))


def normalise_phrase(text: str, corrections: dict[str, str] | None = None) -> str:
    table = WORD_CORRECTIONS if corrections is None else corrections
    return " ".join(table.get(w, w) for w in normalise_plain(text).split())


@dataclass(frozen=True)
class RulePack:
    """Keyword weights and word corrections of one run."""

    keywords: dict[str, dict[str, float]] = field(default_factory=lambda: KEYWORD_WEIGHTS)
    corrections: dict[str, str] = field(default_factory=lambda: WORD_CORRECTIONS)
    subtypes: dict[str, list[str]] = field(default_factory=lambda: FEATURE_SUBTYPES)

    def with_files(self, spark, keywords_path: str | None = None, corrections_path: str | None = None):
        """Replace tables by user files (read through Spark, so any file system works)."""
        pack = self
        if keywords_path:
            raw = _read_text(spark, keywords_path)
            if raw:
                pack = replace(pack, keywords=_parse_keywords(raw) or pack.keywords)
        if corrections_path:
            raw = _read_text(spark, corrections_path)
            if raw:
                try:
                    pack = replace(pack, corrections={str(k): str(v) for k, v in json.loads(raw).items()})
                except (ValueError, AttributeError):
                    pass
        return pack

    def keyword_rows(self) -> list[tuple[str, int, str, str, float]]:
        """(category, ordinal, keyword, normal form, weight) in scoring order."""
        rows = []
        for ordinal, (category, table) in enumerate(
                (c, t) for c, t in self.keywords.items() if c != "Basegame"):
            for keyword, weight in table.items():
                rows.append((category, ordinal, keyword, normalise_phrase(keyword, self.corrections), float(weight)))
        return rows


def _read_text(spark, path: str) -> str:
    """Whole rule file as text, empty if there is none; rule files are configuration of a few kilobytes."""
    from ..session import path_exists
    if not path_exists(spark, path):
        return ""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).take(1))


def _parse_keywords(raw: str) -> dict[str, dict[str, float]]:
    """Two-level ``category: {keyword: weight}`` text, as JSON or plain indented YAML."""
    try:
        data = json.loads(raw)
    except ValueError:
        data, current = {}, None
        for line in raw.splitlines():
            body = line.split("#")[0].rstrip()
            if not body.strip() or ":" not in body:
                continue
            key, _, value = body.strip().rpartition(":")
            key = key.strip().strip("'\"")
            if not body.startswith((" ", "\t")):
                current = data.setdefault(key, {})
            elif current is not None:
                current[key] = float(value)
    return {str(c): {str(k): float(w) for k, w in (t or {}).items()} for c, t in data.items()}


DEFAULT_PACK = RulePack()
