"""Random run logs, and a plain loop over one job's events as the yardstick for the operators."""

import json
import random

KINDS = [
    ("PROJECT", "start"), ("PROJECT", "end"), ("GROUP_ITERATION", "start"), ("GROUP_ITERATION", "end"),
    ("ITERATION", "start"), ("ITERATION", "start"), ("ITERATION", "end"), ("TRAJECTORY", "start"),
    ("TRAJECTORY", "end"), ("TRAINING", "start"), ("TRAINING", "end"), ("EPOCH_TRAIN", "start"),
    ("EPOCH_TRAIN", "end"), ("EVAL_TRAINING", "start"), ("EVAL_TRAINING", "end"), ("EVAL_TRAINING", "metrics"),
    ("EVAL_MODEL", "start"), ("EVAL_MODEL", "start"), ("EVAL_MODEL", "metrics"), ("EVAL_MODEL", "end"),
    ("INIT", "log"), ("TRAINING", "epoch_complete"),
]


def random_event(rng, minute):
    phase, event = rng.choice(KINDS)
    data = {}
    if event == "start":
        data["config"] = {"dataset": rng.choice(["eval", "train"]), "model_epoch": rng.choice([1, 2, "3"])}
        if phase == "GROUP_ITERATION":
            data["config"]["no_iterations"] = rng.choice([2, 3, None])
        if phase == "ITERATION":
            data["config"]["runtime"] = {"current_iteration": rng.choice([1, 2, 3, 4, None])}
        if phase == "EPOCH_TRAIN":
            data["epoch"] = rng.choice([0, 1, 2, "2", "x", None])
    elif event == "end":
        data["duration"] = rng.choice([None, 0, 1.25, -3, 1441, "1.5", "abc", 7])
        data["metrics"] = {"avg_loss": rng.random()}
    elif event == "metrics":
        data["metrics"] = {"answer_reward": {"percentage": rng.choice([0.0, 0.5, 1.0])}}
        data["metrics_json_path"] = f"m{minute}.json"
    stamp = f"2026-02-0{1 + minute // 1440} {minute // 60 % 24:02d}:{minute % 60:02d}:00"
    return {"timestamp": stamp, "phase": phase, "event": event, "data": data}


def random_log(seed, rows):
    rng = random.Random(seed)
    return [random_event(rng, minute) for minute in range(rows)]


def _number(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _epoch(value):
    try:
        return int(value) if int(value) >= 1 else None
    except (TypeError, ValueError):
        return None


def loop_spans(events):
    """``{start_seq: span}`` for one job, by walking its events in order."""
    held, number, spans = {}, None, {}
    for seq, e in enumerate(events, 1):
        phase, event, data = e["phase"], e["event"], e["data"]
        config = data.get("config", {})
        if event == "start":
            own = {"PROJECT": 1, "GROUP_ITERATION": config.get("no_iterations")}.get(phase)
            parent = None
            if phase == "ITERATION":
                own = number = config["runtime"]["current_iteration"]
            elif phase in ("TRAJECTORY", "TRAINING", "EVAL_TRAINING"):
                if "ITERATION" not in held or number is None:
                    continue
                own = number
            elif phase == "EPOCH_TRAIN":
                if "TRAINING" not in held or _epoch(data["epoch"]) is None or number is None:
                    continue
                own, parent = number, held["TRAINING"]
            elif phase == "EVAL_MODEL":
                if "EVAL_TRAINING" not in held:
                    continue
                own, parent = number, held["EVAL_TRAINING"]
            spans[seq] = {"phase": phase, "number": own, "parent": parent, "end": None, "metrics": None}
            held[phase] = seq
        elif event == "end" and phase in held:
            raw = data["duration"]
            if phase in ("ITERATION", "EVAL_TRAINING") and raw is not None and _number(raw) is None:
                continue
            spans[held[phase]]["end"] = seq
            if phase not in ("PROJECT", "GROUP_ITERATION", "EVAL_TRAINING"):
                del held[phase]
        elif event == "metrics" and phase in held and phase in ("EVAL_MODEL", "EVAL_TRAINING"):
            spans[held[phase]]["metrics"] = seq
    return spans


def loop_minutes(phase, raw, start_minute, end_minute):
    """Duration rule of a phase over the generated clock of one minute per event."""
    value, elapsed = _number(raw), max(0.0, float(end_minute - start_minute))
    if phase in ("TRAINING", "EPOCH_TRAIN", "EVAL_MODEL"):
        return value if value is not None and 0 <= value <= 1440 else elapsed
    return elapsed if not raw else value


def as_lines(job, events):
    return [(job, seq, json.dumps(e)) for seq, e in enumerate(events, 1)]
