"""Rule tables: one text that fires and one that does not per signal, and override order."""

import ast

from framelens.functions import rules as R
from framelens.functions import signals as S
from framelens.functions import text as T
from framelens.operators import classify as K
from framelens.operators import review as RV
from framelens.sources import naming as NA
from framelens.sources import results as RE

ITEM = "struct<line_no:int,text:string,x1:double,y1:double,x2:double,y2:double,score:double>"


def item(text, x1=100.0, y1=300.0, x2=300.0, y2=380.0, score=0.9):
    return (0, text, x1, y1, x2, y2, score)


def frame(spark, cases, extra=""):
    return spark.createDataFrame([(n, list(items), 400, 900, 3.0, 3.0, 3.0) for n, items in enumerate(cases)],
                                 f"frame_idx int, items array<{ITEM}>, roi_w int, roi_h int, feature_board_score double, help_quality_score double, help_paytable_score double")


LOW = dict(y1=600.0, y2=660.0)
CASES = {
    "start_button": ([item("Tap to Start", **LOW)], [item("Tap to Start", y1=10.0, y2=60.0)]),
    "large_result": ([item("TOTAL WIN"), item("12500")], [item("TOTAL WIN")]),
    "collect_button": ([item("COLLECT", **LOW)], [item("COLLECT", y1=10.0, y2=60.0)]),
    "blocking_modal": ([item("Transaction ID"), item("ACCEPT")], [item("ACCEPT")]),
    "loading_strong": ([item("Loading resource")], [item("turbo")]),
    "loading_cover": ([item("PG Soft"), item("featuring wild symbols")], [item("PG Soft"), item("paytable"), item("featuring")]),
    "transition_cover": ([item("Congratulations"), item("10 free spins")], [item("Congratulations")]),
    "feature_running": ([item("Remaining Free Spins 8")], [item("Free Spins 8 to win")]),
    "feature_intro": ([item("all 3 features are activated")], [item("balance 10")]),
    "feature_buy": ([item("Buy Feature"), item("Cost 200")], [item("Buy Feature")]),
    "help_page": ([item("Game rules")], [item("symbols pay anywhere"), item("credit 20")]),
    "transition_strong": ([item("press start")], [item("balance")]),
    "result_strong": ([item("you won")], [item("total win multiplier")]),
    "inline_banner": ([item("win 25")], [item("total win 25")]),
    "center_payout": ([item("12,500")], [item("125")]),
    "bigwin_strong": ([item("MEGAWIN")], [item("winner")]),
    "bigwin_title": ([item("nice"), item("5")], [item("nicer"), item("5")]),
    "jackpot_meter": ([item("grand 5000"), item("major 200")], [item("grand 5000")]),
    "record_spins_left": ([item("free spins left", score=0.1)], [item("free spins", score=0.9)]),
    "record_feature_text": ([item("last free spin", score=0.2)], [item("free spin")]),
    "record_strong_counter": ([item("free spins 3 of 10")], [item("free spins")]),
    "record_counter_over_board": ([item("free spins 7")], [item("free spins 7"), item("press")]),
    "record_start_intro": ([item("begin")], [item("balance")]),
    "record_result_text": ([item("total 500 win")], [item("total bet 5")]),
    "record_base_text": ([item("turbo")], [item("hello")]),
    "record_web_chrome": ([item("google chrome"), item("page 2")], [item("page 2")]),
    "plain_rule_help": ([item(f"wild symbol substitutes all but scatter number {n}") for n in range(6)], [item("wild symbol")]),
    "record_award": ([item("you have won 5 free spins")], [item("you have won")]),
    "record_settings": ([item("settings menu")], [item("menu")]),
    "record_intro": ([item("bonus round")], [item("round")]),
    "action_phrase": ([item("continue")], [item("stop")]),
    "total_win": ([item("you ve won")], [item("no win")]),
}


def test_every_signal_has_a_case():
    assert set(CASES) == set(S.SIGNALS)


def test_signals_fire_and_stay_silent(spark):
    names = list(CASES)
    df = S.with_signals(T.with_text(frame(spark, [c for n in names for c in CASES[n]])))
    rows = {r.frame_idx: r for r in df.collect()}
    wrong = [(n, "positive") for i, n in enumerate(names) if not rows[2 * i][f"sig_{n}"]]
    wrong += [(n, "negative") for i, n in enumerate(names) if rows[2 * i + 1][f"sig_{n}"]]
    assert wrong == []


def test_patterns_on_normalised_text_never_fire(spark):
    texts = ["free game 3/10", "win: 25", "12.50", "+ -"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{T.normalize_text('t')} AS joined")
    for key in ("fraction", "win_colon", "decimal"):
        assert df.where(T.has_any_pattern("joined", key)).count() == 0


def test_word_correction_is_one_pass(spark):
    got = [r[0] for r in spark.sql("SELECT 'Tree SNINS info 1a' AS t UNION ALL SELECT 'iofregspins megw!'").selectExpr(T.normalize_text("t")).collect()]
    assert got == ["free spins into 1a", "10 free spins mega"]


def test_needles_decide_like_the_full_test(spark):
    texts = ["free   spin s", "x freespins", "logo", "loading re", "buyfeature", "total w in multiplier"]
    df = spark.createDataFrame([(T_,) for T_ in texts], "t string")
    for key, phrases in R.PHRASES.items():
        got = [r[0] for r in df.selectExpr(T.has_any("t", key)).collect()]
        want = [any(R.normalise_phrase(p) in t or R.normalise_phrase(p).replace(" ", "") in t.replace(" ", "") for p in phrases) for t in texts]
        assert got == want, key


METRICS = dict(dark_ratio=0.0, edge_ratio=0.0, circle_count=0, center_blocks=0, spin_blocks=0, bottom_dark_ratio=0.0, lap_var=0.0, colour_ratio=0.0,
               vertical_lines=0, horizontal_lines=0, plain_ratio=0.0, logo_ratio=0.0, gold_blocks=0, gold_ratio=0.0, centre_dark_ratio=0.0, wide_blocks=0, bar_flag=False)
GAME_UI = dict(dark_ratio=0.5, edge_ratio=0.1, circle_count=3, center_blocks=1, spin_blocks=1)
BOARD = dict(edge_ratio=0.1, lap_var=900.0, colour_ratio=0.5, vertical_lines=4, horizontal_lines=3)


def classify(spark, cases):
    """Classified rows of (items, metrics) cases, in one job."""
    kind = lambda v: "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "int"
    rows = [(n, list(items), 400, 900, *{**METRICS, **metrics}.values()) for n, (items, metrics) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"frame_idx int, items array<{ITEM}>, roi_w int, roi_h int, " + ", ".join(f"{n} {kind(v)}" for n, v in METRICS.items()))
    return K.classify_frames(df).select("frame_idx", "category", "top_score", "matched_keywords", "category_scores").orderBy("frame_idx").collect()


OVERRIDES = [
    ("modal beats text", [item("Transaction ID"), item("ACCEPT")], {}, "Other", "blocking_modal"),
    ("cover text", [item("PG Soft"), item("featuring wild")], {}, "loading", "loading_cover_text"),
    ("transition cover", [item("Congratulations"), item("10 free spins")], {}, "Transition", "priority_transition_cover_text"),
    ("active feature", [item("Remaining Free Spins 8"), item("respin")], {}, "Feature game", "priority_feature_active"),
    ("overlay beats active", [item("MEGAWIN"), item("12,500.00"), item("Remaining Free Spins 8")], {}, "BigWin", "priority_bigwin_overlay"),
    ("help beats overlay", [item("MEGAWIN"), item("12,500.00"), item("paytable")], {}, "Help", "priority_help_page"),
    ("help beats buy", [item("Buy Feature"), item("Cost 200"), item("paytable")], {}, "Help", "priority_help_page"),
    ("buy dialog", [item("Buy Feature"), item("Cost 200")], {}, "Feature Buy", "priority_feature_buy_modal"),
    ("three buttons are control", [item("hello")], GAME_UI, "Basegame", "priority_basegame_ui"),
    ("nothing is other", [], {}, "Other", "basegame_missing_explicit_spin_control"),
    ("controls make base game", [item("turbo"), item("balance 20")], GAME_UI, "Basegame", "priority_basegame_ui"),
    ("no control is other", [item("hello")], {**GAME_UI, "circle_count": 2}, "Other", "basegame_missing_explicit_spin_control"),
    ("banner before control", [item("win 25"), item("turbo")], GAME_UI, "Other", "inline_win_banner_not_basegame"),
    ("weak interface is other", [item("turbo")], {}, "Other", "basegame_ui_too_weak"),
    ("big number on the board", [item("12,500"), item("turbo")], GAME_UI, "BigWin", "large_center_payout_text"),
    ("interface protects result", [item("collect", y1=10.0, y2=20.0), item("turbo")], GAME_UI, "Basegame", "protected_ui_not_result"),
    ("counter over board", [item("free spins 7")], BOARD, "Feature game", "free_spin_counter_over_reel_board"),
]


def test_override_precedence(spark):
    got = classify(spark, [(items, metrics) for _, items, metrics, _, _ in OVERRIDES])
    wrong = [(name, r.category, r.matched_keywords.get(category)) for (name, _, _, category, reason), r in zip(OVERRIDES, got)
             if r.category != category or not any(reason in x for x in r.matched_keywords[category])]
    assert wrong == []


def test_rule_files_replace_tables(spark, tmp_path):
    (tmp_path / "k.yaml").write_text("loading:\n  'wait here': 3\nHelp:\n  rules: 2\n")
    (tmp_path / "c.json").write_text('{"wrongg": "wrong"}')
    pack = R.DEFAULT_PACK.with_files(spark, str(tmp_path / "k.yaml"), str(tmp_path / "c.json"))
    assert pack.keywords == {"loading": {"wait here": 3.0}, "Help": {"rules": 2.0}} and pack.corrections == {"wrongg": "wrong"}
    assert R.DEFAULT_PACK.with_files(spark, str(tmp_path / "missing.yaml")).keywords == R.KEYWORD_WEIGHTS
    assert len(R.DEFAULT_PACK.keyword_rows()) == sum(len(t) for t in R.KEYWORD_WEIGHTS.values())


def test_literal_parsing(spark):
    df = spark.sql("""SELECT "{'Help': 12.5, 'x': 1}" AS a, "[('it', 0.9), ('', 0.1), ('x', 'bad'), ('Wild (x2)', None)]" AS b, "nonsense[" AS c""")
    r = df.selectExpr(f"{RE.parse_literal('a', 'map<string,double>')} AS a", f"{RE.row_items('b')} AS b", f"{RE.parse_literal('c', 'map<string,double>', 'map()')} AS c").first()
    assert r.a == {"Help": 12.5, "x": 1.0} and [(i.text, i.score) for i in r.b] == [("it", 0.9), ("x", 0.0), ("Wild (x2)", 0.0)] and r.c == {}


def test_literals_read_as_python_reads_them(spark):
    values = ["Wild (x2)", "it's [x]", 'say "hi"', "both ' and \"", "back\\slash", "None", "a, b: {c}", "日本", ""]
    df = spark.createDataFrame([(n, [(v, 0.5)], {"k": [v, "z"]}, repr([(v, 0.5)])) for n, v in enumerate(values)], "n int, items array<struct<text:string,score:double>>, hits map<string,array<string>>, py string")
    rows = df.selectExpr("*", f"{RE.literal_texts('items')} AS t", f"{RE.literal_lists('hits')} AS h").selectExpr(
        "*", f"{RE.row_items('t')} AS back", f"{RE.row_items('py')} AS python", f"{RE.parse_literal('h', 'map<string,array<string>>')} AS hits_back").orderBy("n").collect()
    for r, v in zip(rows, values):
        assert ast.literal_eval(r.t) == [(v, 0.5)] and ast.literal_eval(r.h) == {"k": [v, "z"]}
        assert [i.text for i in r.back] == [i.text for i in r.python] == ([v] if v else []) and r.hits_back == {"k": [v, "z"]}


def test_first_correction_of_a_file_wins(spark):
    paths = {0: "out/Help/0.jpg", 1: "out/Help/1.jpg", 2: "out/Help/2.jpg", 3: "out/Help/3.jpg", 4: "out/BigWin/1.jpg"}
    records = spark.createDataFrame([(n, n, "Help", p) for n, p in paths.items()] + [(10, 0, "Help", "out/Help/old.jpg"), (-1, 0, "Help", "out/Help/older.jpg")], "line bigint, frame_idx bigint, category string, save_path string")
    payload = """{"video_id":"v","corrections":[{"frame_idx":0,"action":"exclude","save_path":"out/Help/0.jpg"},{"frame_idx":1,"action":"reclassify","save_path":"out/Help/1.jpg","new_category":"Other"},
      {"frame_idx":2,"action":"reclassify","save_path":"out/Help/2.jpg","new_category":""},{"frame_idx":3,"action":"dance","save_path":"out/Help/3.jpg"},
      {"frame_idx":1,"action":"exclude","save_path":"out/Help/1.jpg"},{"frame_idx":4,"action":"reclassify","save_path":"out/BigWin/1.jpg","new_category":"Other"}]}"""
    rows = RV.read_corrections(spark.createDataFrame([(payload,)], "p string"), "p", "session")
    assert {r.output_dir for r in rows.collect()} == {"session"}
    files = records.selectExpr("save_path AS path")
    checked = RV.checked_corrections(rows, files, "seq")
    assert [r.outcome for r in checked.orderBy("seq").collect()] == ["moved", "moved", "no_category", "ignored", "missing_file", "moved"]
    out = RV.apply_corrections(records, checked, files, ["frame_idx"], "seq", "line")
    assert sorted((r.line, r.category, r.save_path) for r in out.collect()) == [
        (-1, "Help", "out/Help/older.jpg"), (0, "Help", "out/Help/0.jpg"), (1, "Other", "session/Other/1.jpg"), (2, "Help", "out/Help/2.jpg"),
        (3, "Help", "out/Help/3.jpg"), (4, "Other", "session/Other/1_1.jpg"), (10, "Excluded", "session/excluded/0.jpg")]
    s = RV.correction_summary(checked).first()
    assert (s.moved, s.skipped, s.updated) == (3, 2, True)


def test_numbered_names_pass_over_taken_ones(spark):
    df = spark.createDataFrame([(n, "o/a.jpg") for n in range(4)] + [(9, "o/b.jpg")], "id bigint, target string")
    taken = spark.createDataFrame([("o/a.jpg",), ("o/a_1.jpg",), ("o/a_3.jpg",)], "target string")
    got = [r.unique_target for r in NA.unique_targets(df, "target", "id", taken).orderBy("id").collect()]
    assert got == ["o/a_2.jpg", "o/a_4.jpg", "o/a_5.jpg", "o/a_6.jpg", "o/b.jpg"]


def test_page_text_and_ranked_scores_are_made_once_a_frame():
    assert "transform(lines" not in S.rules_page("a", "b", "c") + S._REGISTRY["help_page"][1]
    assert K.confidence("category", "top", "scores", "hits").count("sort_array") == 1
    entries, per_category = K._reason_map([]).split("map_from_arrays")
    assert "trace" in entries and "trace" not in per_category


def test_reasons_are_listed_by_compiled_code(spark):
    """Conditions that are false or unknown and codes without a value add nothing; nothing is evaluated node by node."""
    from framelens.functions import scores as V
    terms = [V.Term("a > 1", 1, "first"), V.Term("b > 1", 1, "concat('b:', c)"), V.Term("a > 0", 1, None), V.Term("a > 0", 1, "last")]
    df = spark.sql("SELECT * FROM VALUES (1, 2, 'x'), (2, NULL, 'x'), (2, 2, NULL), (0, 0, 'y') AS t(a, b, c)").selectExpr(f"{V.reasons(terms)} AS r")
    assert [r.r for r in df.collect()] == [["b:x", "last"], ["first", "last"], ["first", "last"], []]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in spark.range(1).selectExpr(f"{V.present([], 'string')} AS r")._jdf.queryExecution().analyzed().toString()


def test_every_match_of_a_pattern_has_a_substring_it_needs():
    """Texts strung together from pieces of the patterns: whatever matches passes the cheaper search before it."""
    import random
    import re
    rnd = random.Random(7)
    pieces = ("free spin spins game games remaining remains remain last left until end of feature features activated all are chance chances to play win wim wn loin jumbo mega megawi "
              "big super egawink legawin 3of10 win:25 congratulations youhavewon youwon freespin freespins chancestoplay total epic x b 1 25 300 12.50 3/10 / : . , of f start").split()
    fired = set()
    for _ in range(40_000):
        text = rnd.choice(["", " "]).join(rnd.choice(pieces) for _ in range(rnd.randint(1, 5)))
        for key, needs in R.PATTERN_NEEDS.items():
            if any(re.search(p, text) for p in R.PATTERNS[key]):
                fired.add(key)
                assert any(n in text for n in needs), (key, text)
    assert fired == set(R.PATTERN_NEEDS)
