"""Structure repair and chat formatting against brute force, on awkward rows and on an empty table."""

import hashlib
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from cairn.llm import chat, structure

ROWS = "conv_id long, turn long, role string, text string, edit string, place int, state string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], ROWS)


AWKWARD = [
    (1, 0, "user", "Hi."),
    (1, 1, "assistant", "Hello."),
    (1, 1, "assistant", "Hello."),
    (1, None, "system", "Rules."),
    (2, 5, None, None),
    (2, 7, "tool", "<s>[/ROLE]</s> \\ [\\INST] [INST"),
    (2, 9, "user", ""),
    (3, 1, "", " \t\n"),
    (None, 1, "user", "no id?"),
    (None, None, None, None),
    (4, 1, "user", "word " * 50_000),
    (4, 2, "ro\nle</s>", "é 😀 [\\/INST] \\\\ <"),
    (5, 2, "user", "Same?"),
    (5, 2, "assistant", "Same?"),
]


# --- repair ---------------------------------------------------------------------------


def cheapest(rows):
    """(cost, edits) by trying everything: rows of (initial, unwanted, cut off)."""

    @lru_cache(None)
    def rest(i, made, inserted):
        ways = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", made):
                ways.append((0, ""))
        else:
            initial, unwanted, late = rows[i]
            cost, edits = rest(i + 1, made, 0)
            ways.append((cost + 3, "D" + edits))
            if not unwanted:
                cost, edits = rest(i + 1, made + (initial or "?"), 0)
                ways.append((cost + late, "K" + edits))
                for r in "ua":
                    cost, edits = rest(i + 1, made + r, 0)
                    ways.append((cost + 2 + late, "R" + edits))
        if inserted < 2:
            for r in "ua":
                cost, edits = rest(i, made + r, inserted + 1)
                ways.append((cost + 2, "I" + edits))
        return min(ways, default=(10**9, ""))

    return rest(0, "", 0)


def table_driven(rows):
    """(cost, edits) by a table from the end, where the first letter decides between equal costs."""
    far = (10**9, "")

    def insert(f):
        for _ in range(3):
            f = [min(f[q], (f[structure.MADE[q]][0] + 2, "I" + f[structure.MADE[q]][1])) for q in range(4)]
        return f

    f = insert([(0, ""), far, far, (0, "")])
    for initial, unwanted, late in reversed(rows):
        g = []
        for q in range(4):
            ways = [(f[q][0] + 3, "D" + f[q][1])]
            if not unwanted:
                if initial in structure.KEPT[q]:
                    kept = f[structure.KEPT[q][initial]]
                    ways.append((kept[0] + late, "K" + kept[1]))
                made = f[structure.MADE[q]]
                ways.append((made[0] + 2 + late, "R" + made[1]))
            g.append(min(ways))
        f = insert(g)
    return f[0]


def searched(rows):
    s, out, most = structure.Survivors(), "", 0
    for row in rows:
        s.read(*row)
        out += s.shared()
        most = max(most, s.waiting)
    out += s.rest()
    cost, at = 0, 0
    for e in out:
        cost += {"K": 0, "R": 2, "D": 3, "I": 2}[e]
        if e != "I":
            cost += e != "D" and rows[at][2]
            at += 1
    return (cost, out), most


@pytest.mark.parametrize("patience", [1, 32])
def test_search_against_all_edits(monkeypatch, patience):
    monkeypatch.setattr(structure, "PATIENCE", patience)
    draw = random.Random(patience)
    for _ in range(60):
        rows = tuple((draw.choice(["s", "u", "a", "t", ""]), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randrange(4)))
        assert searched(rows)[0] == cheapest(rows)


def test_search_of_long_conversations():
    draw = random.Random(3)
    for k in range(120):
        roles = ["ua", "uuuuua", "u", "su", "suat", "aaa", "t"][k % 7]
        rows = [(draw.choice(roles), draw.random() < 0.1, draw.random() < 0.2 * (k % 2)) for _ in range(draw.randrange(300))]
        assert searched(rows)[0] == table_driven(rows)


def test_survivors_coalesce_and_the_window_stays_small():
    rows = [("ua"[k % 2], k % 20 == 0, k % 7 == 0) for k in range(20_000)]
    (_, edits), most = searched(rows)
    assert most <= 4 * structure.PATIENCE and edits == table_driven(rows[:20_000])[1]


def expected(rows):
    """The report of one conversation, by hand."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    facts, seen, n = [], set(), dict.fromkeys(structure.COUNTS, 0)
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        facts.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    n["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(facts, facts[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n["cost"], audit = table_driven(facts)
    at, out = 0, []
    for e in audit:
        _, role, text = (None, None, "") if e == "I" else rows[at]
        at += e != "I"
        if e != "D":
            last = out[-1][0] if out else ""
            out.append((role if e == "K" else "assistant" if last[:1] == "u" else "user", text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return (*n.values(), audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest())


def test_repair_of_awkward_rows(spark):
    got = {r[0]: tuple(r)[1:] for r in structure.report(structure.repair(table(spark, AWKWARD))).collect()}
    assert got == {c: expected([r[1:] for r in AWKWARD if r[0] == c]) for c in {r[0] for r in AWKWARD}}
    edits = structure.repair(table(spark, AWKWARD)).filter("conv_id = 1").orderBy("place").collect()
    assert [(r.edit, r.role, r.text, r.turn, r.fault) for r in edits] == [
        ("K", "system", "Rules.", None, None),
        ("K", "user", "Hi.", 0, None),
        ("K", "assistant", "Hello.", 1, None),
        ("D", "assistant", None, 1, "duplicate"),
    ]
    assert structure.repair(table(spark, [])).count() == 0 and structure.repaired_damage(table(spark, [])).count() == 0


def test_report_of_a_written_table(spark, tmp_path):
    edits = structure.repair(table(spark, AWKWARD))
    edits.repartition(3).write.parquet(str(tmp_path / "edits"))
    again = spark.read.parquet(str(tmp_path / "edits")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    assert sorted(map(str, structure.report(again).collect())) == sorted(map(str, structure.report(edits).collect()))


def test_damage_and_whole_conversations_lost(spark):
    import zlib

    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    twice = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 3)
    rows = [(lost, 0, "user", "Gone."), (twice, 0, "user", "Here."), (None, None, None, None)]
    got = {r.conv_id: r for r in structure.repaired_damage(table(spark, rows)).collect()}
    assert tuple(got[lost])[1:] == (0,) * 6 + ("", hashlib.sha256().hexdigest())
    assert got[twice].duplicate == 1 and got[twice].audit == "KDI" and len(got) == 3
    damaged = structure.damage(table(spark, [(c, t, "assistant", "A. B! C?") for c in range(40) for t in range(10)])).collect()
    by = {}
    for r in damaged:
        by.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c in range(40):
        for t in range(10):
            d = zlib.crc32(f"{c}:{t}".encode()) % 20
            role, text = "user" if d == 4 else "assistant", {1: "", 2: "A B C"}.get(d, "A. B! C?")
            assert by.get((c, t), []) == [(role, text)] * {0: 0, 3: 2}.get(d, 1)


# --- formatting ---------------------------------------------------------------------------


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    draw = random.Random(5)
    parts = [*chat.CHAT.controls(), "\\", "<", "[", "/", "s>", "INST]", "a", " ", "\n", "é", "$1"]
    texts = ["", "\\", *("".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("e", chat.escaped(F.col("text")))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.text and not any(c in r.e for c in chat.CHAT.controls())


def test_formatting_of_awkward_rows(spark):
    rows = chat.with_probe(table(spark, AWKWARD))
    made = chat.format_chats(rows)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    texts = {r.conv_id: r for r in made.collect()}
    probe = "</s>[INST] ok [/INST]"
    for conv in {r[0] for r in AWKWARD} | {-1}:
        mine = [r[1:] for r in AWKWARD if r[0] == conv] or [(0, "user", probe), (1, "assistant", probe)]
        mine = sorted(((t, r or "", x or "") for t, r, x in mine), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        g, t = got[conv], texts[conv]
        assert g.n_turns == len(mine) and g.loss_chars == len(loss) and g.formatted_chars == len(t.formatted)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert t.formatted == "".join(s.text for s in t.segments) and t.formatted.count("</s>") == len(mine)
        assert sum(s.loss for s in t.segments) == sum(r == "assistant" for _, r, _ in mine)
    assert chat.format_chats(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    "roles, want",
    [
        (["system", "user", "assistant"], (0, None, True)),
        (["user", "assistant", "user"], (0, None, False)),
        (["assistant", "user", "assistant"], (1, 0, True)),
        (["user", "user", "assistant", "system", "user"], (2, 1, False)),
        (["user", "tool", "assistant"], (2, 1, True)),
    ],
)
def test_machine_over_roles(spark, roles, want):
    rows = [(1, k, r, "x") for k, r in enumerate(roles)]
    (r,) = chat.format_chats(table(spark, rows)).collect()
    assert (r.n_faults, r.first_fault, r.complete) == want


def test_a_template_of_its_own(spark):
    template = chat.Template(
        marks={"user": ("<|u|>", "<|/u|>"), "tool": ("<|t|>", "")},
        loss=frozenset({"tool"}),
        escape="~",
        follows={("begin", "user"): "user", ("user", "tool"): "user"},
        complete=frozenset({"user"}),
    )
    rows = [(1, 0, "user", "a ~ <|u|> <s>"), (1, 1, "tool", "b~<|t|>"), (1, 2, "tool", "c")]
    made = chat.format_chats(table(spark, rows), template)
    (r,) = chat.read_back(made, template).collect()
    assert (r.n_turns, r.loss_chars, r.n_faults, r.complete) == (3, len("b~<|t|>c"), 0, True)
    assert r.turns_sha256 == hashlib.sha256(b"user\na ~ <|u|> <s>\ntool\nb~<|t|>\ntool\nc\n").hexdigest()
    assert made.first().formatted.startswith("<s><|u|>a ~~ <~|u|> <~s><|/u|></s>")
