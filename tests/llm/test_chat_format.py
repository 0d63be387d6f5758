import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagefacts.llm import chat_format as C

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string, piece int"
ROWS = "conv_id long, turn long, role string, text string, copy string, seq int"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN ", "[/TURN]", "\\", "]", " ", "<", "[", "/", "s>", "a", "\n", "é", "🙂"]


def folded(spark, events):
    df = spark.createDataFrame([(*e, 0) for e in events], EVENTS)
    return sorted(map(tuple, C.final_messages(df).collect()), key=repr)


def by_hand(events):
    """The log replayed event by event."""
    low = lambda x: (x is not None, x if x is not None else 0)
    state = {}
    for conv, message, _, kind, role, text in sorted(set(events), key=lambda e: (low(e[0]), low(e[2]), e[3], e[4] or "", e[5] or "")):
        own = state.setdefault(conv, {})
        now = own.setdefault(message, ["", "", None])
        if kind == "open":
            own[message] = [role or "", text or "", None]
        elif kind == "delta":
            now[1] += text or ""
        elif kind == "edit":
            now[1] = text or ""
        elif kind == "regenerate":
            now[1] = ""
            for m in [m for m in own if low(m) > low(message)]:
                del own[m]
    return sorted(((c, m, r, t) for c, own in state.items() for m, (r, t, _) in own.items()), key=repr)


def test_fold(spark):
    events = [
        (1, 0, 1, "open", "user", "dr"), (1, 0, 2, "delta", None, "aft"), (1, 0, 3, "edit", None, "final"), (1, 0, 4, "delta", None, " text"), (1, 0, 4, "delta", None, " text"),
        (1, 1, 5, "open", "assistant", None), (1, 1, 6, "delta", None, "first try"), (1, 2, 7, "open", "user", "thanks"), (1, 3, 8, "open", "assistant", "welcome"),
        (1, 1, 9, "regenerate", None, None), (1, 1, 10, "delta", None, "second"), (1, 1, 11, "delta", None, " try"), (1, 2, 12, "open", "user", "better"), (1, 2, 13, "delta", None, None),
        (None, None, None, "open", None, "nulls"), (2, 5, 1, "delta", None, "no open"), (2, 6, 2, "typing", None, "x"),
    ]
    assert folded(spark, events) == by_hand([e for e in events if e[3] != "typing"])
    assert (1, 1, "assistant", "second try") in folded(spark, events) and (1, 2, "user", "better") in folded(spark, events)
    assert folded(spark, []) == []


def test_fold_random_logs(spark):
    """A hot conversation with a third of all events; every message opens before its other events."""
    import random

    r = random.Random(5)
    events, seq = [], 0
    for conv in [7] * 12 + list(range(24)):
        first = seq
        for _ in range(25):
            seq += 1
            m = r.randrange(8)
            opened = any(e[0] == conv and e[1] == m for e in events[-400:])
            kind = r.choice(["delta", "delta", "edit", "regenerate", "open"]) if opened else "open"
            events.append((conv, m, seq, kind, "user" if kind == "open" else None, f"t{seq} "))
        assert first < seq
    # A message that was cut off must open again before it goes on.
    state, clean = {}, []
    for e in events:
        own = state.setdefault(e[0], set())
        if e[3] == "open":
            own.add(e[1])
        elif e[1] not in own:
            continue
        elif e[3] == "regenerate":
            own -= {m for m in own if m > e[1]}
        clean.append(e)
    r.shuffle(clean)
    assert folded(spark, clean) == by_hand(clean)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a] b", "[TURN ", "x\\"]), st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join)), max_size=4))
def test_template_is_reversible(said):
    """The template in Python, read back; the columns are held against it below."""
    assert list(C.turns("".join(rendered(r, t) for r, t in said))) == said


def escape(x):
    import re

    return re.sub(C._CONTROL, r"\1\\\2", x.replace("\\", "\\\\"))


def rendered(role, text):
    opens = C.OPENS.get(role) or C.OTHER_OPENS[0] + escape(role).replace("]", "\\]") + C.OTHER_OPENS[1]
    return opens + escape(text) + (C.CLOSES.get(role) or C.OTHER_CLOSES)


def test_pieces(spark):
    said = [(r, "".join(CONTROLS[i : i + n])) for i in range(len(CONTROLS)) for n in (0, 1, 2, 5) for r in ("user", "assistant", "system", "a] b", "[TURN ")] + [("assistant", t) for _, _, _, t in C.CONTROL_CONVERSATION]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)] + [(2, 0, None, None)], "conv_id long, message long, role string, text string")
    out = {(x.conv_id, x.message): x for x in C.formatted(df).collect()}
    for i, (r, t) in enumerate(said):
        x = out[1, i]
        assert x.piece == rendered(r, t)
        assert C.unescaped(x.piece[x.loss_start : x.loss_start + x.loss_chars]) == (t if r == "assistant" else "")
    assert list(C.turns("".join(out[1, i].piece for i in range(len(said))))) == said and list(C.turns(out[2, 0].piece)) == [("", "")]
    with pytest.raises(ValueError):
        list(C.turns("no turn"))


def expected(rows):
    rows = sorted([(c, t, r or "", x or "") for c, t, r, x in [*rows, *C.CONTROL_CONVERSATION]], key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), r[2].encode(), r[3].encode()))
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == conv]
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out.append((conv, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(rendered(r, x)) for _, _, r, x in own)))
    return sorted(out, key=repr)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, None, "assistant", "a"), (2, 0, None, "b"), (None, 0, "user", "c"), (None, 0, "user", "c"), (3, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "assistant", "y"), (3, 1, "user", "w"),
        (4, 2**62, "user", "late"), (4, -(2**62), "system", "early"), (5, 0, "assistant", "lang é🙂 " * 60_000), (5, 1, "user", "<s>[INST] \\ " * 5_000), (-7, 2, "user", "more"),
    ]
    out = C.formatted_conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS))
    assert sorted(map(tuple, out.collect()), key=repr) == expected(rows)
    assert sorted(map(tuple, C.formatted_conversations(spark.createDataFrame([], ROWS)).collect())) == expected([])


def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    out, want = C.formatted_conversations(spark.read.parquet(f"{sf}/conversations.parquet")), db.sql(C.sql())
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())
