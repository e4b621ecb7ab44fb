"""Conversation repair against dynamic programming over the same edits."""

from __future__ import annotations

import hashlib
import random

from compare import differences, duck
from hypothesis import given, settings, strategies as st

from stallwise.llm import queries, repair as R

SF = "/root/testdata/sf0.01"


def best_edits(codes, entry=R.NOTHING, exits=R.ENDS):
    def with_inserts(now):
        for _ in range(8):
            for state, (cost, audit) in list(now.items()):
                to, new = R.NEXT[state, R.WANTED[state]], (cost + 3, audit + "I")
                now[to] = min(now.get(to, new), new)
        return now
    now = with_inserts({entry: (0, "")})
    for code in codes:
        after = {}
        def put(state, new):
            after[state] = min(after.get(state, new), new)
        for state, (cost, audit) in now.items():
            put(state, (cost + 4, audit + "D"))
            if code != R.GONE:
                extra = 3 * code.isupper()
                if (state, code.lower()) in R.NEXT:
                    put(R.NEXT[state, code.lower()], (cost + extra, audit + "K"))
                put(R.NEXT[state, R.WANTED[state]], (cost + extra + 3, audit + "R"))
        now = with_inserts(after)
    return min((now[s] for s in exits if s in now), default=None)


@settings(max_examples=400, deadline=None)
@given(st.text("suaxSUAX-", max_size=11), st.integers(0, 3), st.integers(0, 11))
def test_search_is_optimal_and_blocks_chain(codes, entry, cut):
    assert R.search(codes) == best_edits(codes)
    for exit_ in range(4):
        assert R.search(codes, entry, (exit_,)) == best_edits(codes, entry, (exit_,))
    parts = [p for p in (codes[:cut], codes[cut:]) if p]
    if parts:
        cost, audits = R.chain([R.block_answers(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)])
        assert (cost, "".join(audits)) == best_edits(codes)
        assert [len(a) - a.count("I") for a in audits] == [len(p) for p in parts]


def test_bounds_never_exceed_the_cost():
    rng = random.Random(4)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUA-") for _ in range(rng.randint(0, 12)))
        bounds = R.suffix_bounds(codes)
        for i in range(len(codes) + 1):
            for state in range(4):
                assert bounds[i][state == R.USER] <= best_edits(codes[i:], state)[0]


def test_a_long_block_ends_soon():
    rng = random.Random(6)
    for letters in ("suaxSUAX-", "s", "uA", "UUA", "X", "u"):
        codes = "".join(rng.choice(letters) for _ in range(R.BLOCK))
        assert R.search(codes) == best_edits(codes)


def plain(rows):
    """One conversation, row by row: rows are (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).hexdigest()))
    seen, codes, kinds = set(), "", []
    for _, role, text in rows:
        bare = text.strip(R.BLANKS)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "-" if kind in ("blank", "duplicate") else initial.upper() if kind else initial
    cost, audit = best_edits(codes)
    said, out, at = len(audit) - audit.count("D"), [], 0
    for letter in audit:
        wanted = ("user", "assistant")[(len(out) - said % 2) % 2]
        if letter == "K":
            out.append(f"{rows[at][1]}:{rows[at][2]}")
        elif letter == "R":
            out.append(f"{wanted}:{rows[at][2]}")
        elif letter == "I":
            out.append(f"{wanted}:")
        at += letter != "I"
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[1][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in R.LEGAL for a, b in zip(first, first[1:], strict=False)), cost, audit, "\n".join(out))


def test_repair_equals_the_plain_reading(spark):
    rng = random.Random(9)
    texts = ["Hi.", "no", "", " \t", "What? ", None, "x!\n", "é", "same.", "same."]
    chats = {c: [(rng.choice([None, 0, 1, 2, 5, 7]), rng.choice(["user", "assistant", "system", "User", None, "", "tool"]), rng.choice(texts)) for _ in range(rng.randint(1, 6))] for c in [None, *range(30)]}
    chats[99] = [(i, "ua"[rng.random() < 0.5].replace("u", "user").replace("a", "assistant"), f"t{i}{rng.choice(['.', ''])}") for i in range(3 * R.BLOCK + 5)]
    chats[98] = [(1, "user", "long " * 200_000 + "."), (1, "user", "long " * 200_000 + ".")]
    rows = spark.createDataFrame([(c, t, r, x, 1, "z") for c, many in chats.items() for t, r, x in many], "conv_id long, turn long, role string, text string, block int, audit string")
    fixed = R.repair(rows)
    summary = {r["conv_id"]: r for r in fixed.summary.collect()}
    lines = {}
    for r in fixed.turns.collect():
        lines.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    hashes = {r["conv_id"]: r["sha256"] for r in R.digests(fixed.turns).collect()}
    assert set(summary) == set(chats)
    for c, many in chats.items():
        gaps, blank, duplicate, truncated, illegal, cost, audit, text = plain(many)
        r = summary[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, blank, duplicate, truncated, illegal, cost, audit)
        said = sorted(lines.get(c, []))
        assert [p for p, _ in said] == list(range(len(said))) and "\n".join(t for _, t in said) == text
        assert hashes.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(text.encode()).hexdigest()


def test_no_rows(spark):
    fixed = R.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert fixed.summary.count() == 0 and fixed.turns.count() == 0


def test_query_equals_sql(spark):
    assert differences(queries.op12_repair(spark, SF), duck(SF), queries.ORACLES["op12_repair"]) is None
