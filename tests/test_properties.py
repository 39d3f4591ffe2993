"""Property checks on seeded random batches: normalisation equals Python's
split/join and chunk prefixes rebuild the normalised text; role runs and delta
runs follow the rules. Each batch is checked to hold the cases that matter."""

import random

from tessera.operators.chunking import chunk_documents

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a" \
     "\u2028\u2029\u202f\u205f\u3000"
LETTERS = "abcxyzÉéüß漢字\u200b.,!"


def test_chunks_rebuild_normalised_text(spark):
    rng = random.Random(1)
    texts = ["", " ", WS, "x" * 342, "x" * 343, "x" * 1024] + [
        "".join(rng.choice(WS if rng.random() < 0.3 else LETTERS) for _ in range(rng.randint(0, 3000))) for _ in range(60)]
    assert sum(len(" ".join(t.split())) > 1024 for t in texts) > 10
    rows = [(f"d{i}", f"/v/d{i}", 0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_name string, doc_uri string, size bigint, text string")
    got = {}
    for r in chunk_documents(df).collect():
        got.setdefault(r.doc_name, []).append((r.chunk_index, r.content))
    for i, t in enumerate(texts):
        norm = " ".join(t.split())
        chunks = [c for _, c in sorted(got.get(f"d{i}", []))]
        assert chunks == [norm[s:s + 1024] for s in range(0, len(norm), 342)]
        assert "".join(c[:342] for c in chunks) == norm


def _expected(msgs, ignore_old=False):
    """Direct statement of the moderation rules for one valid conversation."""
    rows = []
    for role, text in msgs:
        if role == "tool":
            role, text = "assistant", f"<tool output> {text} </tool_output>"
        if role == "system":
            continue
        rows.append((role, text))
    groups = []
    for role, text in rows:
        if groups and groups[-1][0] == role:
            groups[-1] = (role, groups[-1][1] + "\n\n" + text)
        else:
            groups.append((role, text))
    ok = all((r == "user") == (i % 2 == 0) for i, (r, _) in enumerate(groups))
    if ignore_old and len(groups) > 2:
        return ok, groups[-2:], len(groups) - 2
    return ok, groups, 0


def test_moderation_groups_match_rules(spark):
    rng = random.Random(2)
    convs = [[(rng.choice(["user", "assistant"] if rng.random() < 0.7 else ["system", "tool", "user"]),
               "".join(rng.choice("ab xy") for _ in range(rng.randint(1, 5)))) for _ in range(rng.randint(1, 7))] for _ in range(120)]
    convs += [[("user", "a"), ("user", "b"), ("assistant", "c"), ("system", "s"), ("assistant", "d"), ("user", "e")],
              [("user", "a"), ("assistant", "b"), ("tool", "t"), ("user", "c"), ("assistant", "d")], [("system", "only")]]
    kinds = [_expected(c)[:2] for c in convs]
    assert sum(ok and len(g) > 2 for ok, g in kinds) >= 3 and sum(not ok for ok, _ in kinds) > 10
    assert any(ok and any("\n\n" in t for _, t in g) for ok, g in kinds) and any("<tool output>" in t for _, g in kinds for _, t in g)
    import json

    from tessera.operators import moderation as mod
    rows = [(c, p, json.dumps({"role": r, "content": t})) for c, ms in enumerate(convs) for p, (r, t) in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id long, pos long, message string")
    for ignore_old in (False, True):
        got = {}
        for r in mod.moderation_groups(df, ignore_old=ignore_old).collect():
            got.setdefault(r.conv_id, []).append((r.grp, r.role, r.content))
        errs = {r.conv_id for r in mod.conversation_errors(df).collect()}
        for c, ms in enumerate(convs):
            ok, groups, first = _expected(ms, ignore_old)
            if not ok:
                assert c in errs and c not in got
            elif groups:
                assert sorted(got[c]) == [(first + i, r, t) for i, (r, t) in enumerate(groups)]
                assert c not in errs


def _merge_rule(events):
    """The merge loop: deltas append to an open item, done items pass and close it,
    other types are ignored."""
    from tessera.operators.messages import ITEM_DONE, TEXT_DELTA
    out, open_run = [], False
    for typ, iid, payload in events:
        if typ == ITEM_DONE:
            out.append(("done", iid, payload))
            open_run = False
        elif typ == TEXT_DELTA:
            if not open_run:
                out.append(("delta", iid, payload))
                open_run = True
            else:
                out[-1] = ("delta", out[-1][1], out[-1][2] + payload)
    return out


def test_merge_deltas_matches_rule(spark):
    rng = random.Random(3)
    kinds = ["response.output_text.delta"] * 3 + ["response.output_item.done", "response.created"]
    reqs = [[(rng.choice(kinds), "".join(rng.choice("ab ") for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(1, 15))]
            for _ in range(80)]
    assert any(t1 == t2 == kinds[0] for r in reqs for (t1, _), (t2, _) in zip(r, r[1:])) and any(p == "" for r in reqs for _, p in r)
    from tessera.operators.messages import merge_deltas
    rows, expected = [], {}
    for req, evs in enumerate(reqs):
        seq_evs = [(t, f"i{req}-{s}", p) for s, (t, p) in enumerate(evs)]
        expected[req] = _merge_rule(seq_evs)
        rows += [(req, s, t, iid, p if t != "response.output_item.done" else None,
                  p if t == "response.output_item.done" else None) for s, (t, iid, p) in enumerate(seq_evs)]
    df = spark.createDataFrame(rows, "request_id long, seq long, type string, item_id string, delta string, "
                                     "text string")
    got = {}
    for r in merge_deltas(df).collect():
        got.setdefault(r.request_id, []).append((r.out_pos, r.kind, r.item_id, r.text))
    for req, exp in expected.items():
        assert sorted(got.get(req, [])) == [(i, k, iid, t) for i, (k, iid, t) in enumerate(exp)]
