"""The library's surface for runs: gates, locks, jobs, settings and deletion plans, on driver-side files.

What a server would offer as routes is a method here; transport, pictures and model calls are outside.
"""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strataform.functions.config import Refusal, leaves, longest_prefix, merged
from strataform.operators import journal
from strataform.operators.journal import GATES
from strataform.sources.records import read_json, write_atomic


class Lock:
    """One writer for a folder; a lock whose process is gone may be broken, openly."""

    def __init__(self, folder: str):
        self.path = f"{folder}/.lock"

    def holder(self) -> dict[str, Any] | None:
        return read_json(self.path, None)

    def stale(self) -> bool:
        h = self.holder()
        if h is None or h["host"] != socket.gethostname():
            return False
        try:
            os.kill(h["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False

    def __enter__(self) -> Lock:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        try:
            fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            why = "a dead process holds it" if self.stale() else "another run holds it"
            raise Refusal(f"{self.path}: {why}", remedy="release it") from None
        with os.fdopen(fd, "w") as f:
            json.dump({"pid": os.getpid(), "host": socket.gethostname(), "since": time.strftime("%Y-%m-%d %H:%M:%S")}, f)
        return self

    def __exit__(self, *_: object) -> None:
        Path(self.path).unlink(missing_ok=True)

    def release_dead(self) -> None:
        if not self.stale():
            raise Refusal(f"{self.path} is not held by a dead process")
        Path(self.path).unlink(missing_ok=True)


class Run:
    """One scene's work folder: its journal of gates, settings, and jobs."""

    def __init__(self, spark: SparkSession, folder: str, scene: int = 0, reopens: Mapping[str, str] = {}):
        self.spark, self.folder, self.scene, self.reopens = spark, folder, scene, dict(reopens)
        self.lock = Lock(folder)

    @property
    def _events(self) -> list[dict[str, Any]]:
        return read_json(f"{self.folder}/journal.json", [])

    def events(self) -> DataFrame:
        return self.spark.createDataFrame([(e["seq"], self.scene, e["gate"], e["action"]) for e in self._events], "seq long, scene long, gate long, action string")

    def _append(self, gate: str, action: str, **more: Any) -> None:
        if gate not in GATES:
            raise Refusal(f"there is no gate {gate!r}")
        rows = self._events
        rows.append({"seq": len(rows), "gate": GATES.index(gate) + 1, "action": action, "at": time.strftime("%Y-%m-%d %H:%M:%S"), **more})
        write_atomic(f"{self.folder}/journal.json", json.dumps(rows))

    def standing(self) -> list[str]:
        return [GATES[r.gate - 1] for r in journal.standing(self.events()).orderBy("gate").collect()]

    def next_gate(self) -> str | None:
        done = self.standing()
        return next((g for g in GATES if g not in done), None)

    def approve(self, gate: str, inputs: Mapping[str, str] | None = None) -> None:
        """Only after every earlier gate; later approvals fall."""
        with self.lock:
            done = self.standing()
            open_ = [g for g in GATES[: GATES.index(gate)] if g not in done]
            if open_:
                raise Refusal(f"{open_[0]} has to be approved before {gate}", gate=open_[0])
            self._append(gate, "approve", inputs=dict(inputs or {}))

    def reopen(self, gate: str) -> None:
        with self.lock:
            self._append(gate, "demote")

    def stale(self, live: Mapping[str, str]) -> list[str]:
        """Standing gates whose recorded inputs differ from the live ones."""
        done, out = self.standing(), []
        for g in done:
            last = [e for e in self._events if e["gate"] == GATES.index(g) + 1 and e["action"] == "approve"][-1]
            if any(live.get(k) != v for k, v in last.get("inputs", {}).items()):
                out.append(g)
        return out

    def settings(self) -> dict[str, Any]:
        return read_json(f"{self.folder}/profile.json", {})

    def change_settings(self, values: Mapping[str, Any]) -> list[str]:
        """Writes allowed settings; a changed one first takes back the gate that it reopens. Returns those gates."""
        with self.lock:
            old, new = leaves(self.settings()), leaves(values)
            banned = [k for k in new if longest_prefix(k, self.reopens) is None]
            if banned:
                raise Refusal(f"{banned[0]} may not be changed here")
            gates = sorted({longest_prefix(k, self.reopens) for k, v in new.items() if old.get(k) != v}, key=GATES.index)
            for g in gates[:1]:
                self._append(g, "demote")
            write_atomic(f"{self.folder}/profile.json", json.dumps(merged(self.settings(), values), indent=1))
            return gates

    def start(self, name: str, work: Callable[[], Any], gate: str | None = None) -> Any:
        """Runs one job under the lock and a Spark job group of its own, so that `cancel` can stop it."""
        with self.lock:
            if gate is not None:
                done = self.standing()
                open_ = [g for g in GATES[: GATES.index(gate)] if g not in done]
                if open_:
                    raise Refusal(f"{name} needs {open_[0]}", gate=open_[0])
            sc = self.spark.sparkContext
            sc.setJobGroup(f"strataform-{self.scene}", name, interruptOnCancel=True)
            try:
                return work()
            finally:
                sc.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(f"strataform-{self.scene}")

    def deletion(self, protected: Sequence[str] = ("/", "/root", "/home")) -> dict[str, Any]:
        """What a deletion would remove: files and bytes; refused for protected folders and those that hold them."""
        here = Path(self.folder).resolve()
        if any(Path(p).resolve() == here or here in Path(p).resolve().parents for p in protected):
            raise Refusal(f"{here} is protected")
        files = [p for p in here.rglob("*") if p.is_file()] if here.exists() else []
        return {"folder": str(here), "files": len(files), "bytes": sum(p.stat().st_size for p in files)}


def create(spark: SparkSession, root: str, name: str, answers: Mapping[str, Any]) -> Run:
    """A new scene's folder with a profile from the creation answers."""
    if not name or any(c in name for c in "/\\") or name.startswith("."):
        raise Refusal(f"{name!r} is not a name for a scene")
    folder = f"{root}/{name}"
    if os.path.exists(f"{folder}/profile.json"):
        raise Refusal(f"{name} is there already")
    write_atomic(f"{folder}/profile.json", json.dumps({"scene": dict(answers)}, indent=1))
    return Run(spark, folder)


def inside_folder(folder: str, relative: str) -> str:
    """A path below a folder; one that leaves it is refused."""
    base = Path(folder).resolve()
    path = (base / relative).resolve()
    if base != path and base not in path.parents:
        raise Refusal(f"{relative} lies outside")
    return str(path)
