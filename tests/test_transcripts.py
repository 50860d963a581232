"""Rollouts, task sessions, ownership, listener and prompt scan."""

import json


def test_rollouts_from_files(spark, tmp_path):
    from tessera.sources.transcripts import rollout_episodes, text_lines

    msg = lambda kind, **p: json.dumps({"type": "event_msg", "timestamp": "t1", "payload": {"type": kind, **p}})
    item = lambda kind, **p: json.dumps({"type": "response_item", "payload": {"type": kind, **p}})
    lines = [
        json.dumps({"type": "session_meta", "payload": {"id": "s1", "cwd": "/a"}}), msg("agent_message", message="too early"), msg("user_message", message="  do it "), "not json", msg("agent_message", message="yes"),
        msg("user_message", message="<env>"), item("function_call", name="shell"), item("function_call_output", output="Process exited with code 2\nboom"), item("function_call_output", output="exited with code 0"),
        msg("exec_command_end", exit_code=3, stderr=""), msg("patch_apply_end", success=False, stderr="bad patch"), msg("patch_apply_end", success=True), item("function_call_output", output="command Timed out"),
        msg("user_message", message="The following is the Codex agent history x"), msg("user_message", message="next"), msg("agent_message", message=" "),
    ]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "rollout-1.jsonl").write_text("\n".join(lines))
    (tmp_path / "r" / "rollout-2.jsonl").write_text(msg("user_message", message="hello"))
    got = {(r.session, r.episode): (r.ask, r.answers, r.tools, r.errors) for r in rollout_episodes(text_lines(spark, f"{tmp_path}/r")).collect()}
    assert got == {
        ("s1", 0): ("do it", ["yes"], ["shell"], ["Process exited with code 2\nboom", "exit 3", "bad patch", "command Timed out"]), ("s1", 1): ("next", [], [], []), ("rollout-2", 0): ("hello", [], [], []),
    }


def test_task_sessions_and_owners(spark, tmp_path):
    from tessera.sources.transcripts import owned_by, task_sessions

    rows = {
        "a.json": {"id": "a", "finished": True, "created_at": "c", "messages": [{"role": "user", "content": " What is it? "}, {"role": "assistant", "content": "x"}, {"role": "assistant", "content": None}]},
        "b.json": {"finished": True, "task": "what is IT?"}, "c.json": {"id": "c", "finished": False, "task": "t"}, "d.json": {"finished": True, "task": "other"}, "e.json": {"id": "e", "finished": True},
    }
    (tmp_path / "s").mkdir()
    for name, x in rows.items():
        (tmp_path / "s" / name).write_text(json.dumps(x))
    (tmp_path / "s" / "f.json").write_text("{oops")
    got = sorted((r.session, r.ask, r.answers) for r in task_sessions(spark, f"{tmp_path}/s").collect())
    assert got == [("a", "What is it?", ["x"]), ("d", "other", [])]
    sessions = spark.createDataFrame([("s1", "/w/git/x/sub"), ("s2", "/w/github"), ("s3", "/w/git/"), ("s4", None)], "session string, cwd string")
    roots = spark.createDataFrame([("/w/git",), ("/w/git/x/",), ("/w",)], "path string")
    assert {r.session: r.root for r in owned_by(sessions, roots).collect()} == {"s1": "/w/git/x", "s2": "/w", "s3": "/w/git"}


def test_watch_and_prompt_scan(spark, tmp_path):
    import time

    from tessera.streaming.watch import Watch, scan_prompts

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "Fix src/app.py please" if t % 2 == 0 else "Done. 3 passed. committed") for c in range(8) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.repartition(2, "conv_id").write.parquet(f"{tmp_path}/in")
    watch = Watch()
    spark.streams.addListener(watch)
    try:
        got = [(r.key, r.samples) for r in scan_prompts(spark, f"{tmp_path}/in", table.schema).collect()]
        for _ in range(50):
            if any(k in ("ended", "failed") for k, _, _ in watch.events):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert got == [("action:fix_with_file_short", 8)]
    run = watch.events[0][1]
    assert watch.events[0][0] == "started" and watch.rows(run) == 16 and watch.events[-1][0] == "ended"
