"""A child process that runs a parser for a task. A file on which the parser hangs, crashes or runs out of memory ends the child
only; the task notes an error for that file and goes on with a new child."""

from __future__ import annotations

import contextlib
import os
import pickle
import select
import struct
import subprocess
import sys
import time
from typing import BinaryIO

START_SECONDS = 120.0


class Child:
    """call(*args) is function(*args) as a list, worked out in the child, which is started when it is needed and serves many calls.

    function: as cloudpickle gives it. Raises what the function raised as a RuntimeError with its text, TimeoutError where it took
    longer than ``limit`` seconds, ChildProcessError where the child ended."""

    def __init__(self, function: bytes, limit: float) -> None:
        self.function, self.limit, self.process = function, limit, None

    def __enter__(self) -> Child:
        return self

    def __exit__(self, *_: object) -> None:
        self.stop()

    def call(self, *args: object) -> list:
        if self.process is None:
            command = [sys.executable, "-c", "from plinth.sources.isolated import serve; serve()"]
            self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)})
            self._ask(self.function, START_SECONDS)
        fine, said = pickle.loads(self._ask(pickle.dumps(args, protocol=5), self.limit))
        if not fine:
            raise RuntimeError(said)
        return said

    def stop(self) -> None:
        if self.process is not None:
            process, self.process = self.process, None
            process.kill()
            process.wait()
            process.stdout.close()
            with contextlib.suppress(BrokenPipeError):
                process.stdin.close()

    def _ask(self, message: bytes, limit: float) -> bytes:
        try:
            put(self.process.stdin, message)
            return self._answer(time.monotonic() + limit)
        except TimeoutError:
            self.stop()
            raise TimeoutError(f"no result within {limit:g} seconds") from None
        except (EOFError, BrokenPipeError):
            code = self.process.wait()
            self.stop()
            raise ChildProcessError(f"the parser's process ended with code {code}") from None

    def _answer(self, until: float) -> bytes:
        source, parts, need, head = self.process.stdout.fileno(), [], 8, True
        while True:
            ready, _, _ = select.select([source], [], [], max(0.0, until - time.monotonic()))
            if not ready:
                raise TimeoutError
            part = os.read(source, min(need, 1 << 20))
            if not part:
                raise EOFError
            parts.append(part)
            need -= len(part)
            if need == 0:
                whole = b"".join(parts)
                if not head:
                    return whole
                parts, need, head = [], struct.unpack("<q", whole)[0], False


def put(to: BinaryIO, message: bytes) -> None:
    to.write(struct.pack("<q", len(message)))
    to.write(message)
    to.flush()


def take(source: BinaryIO) -> bytes | None:
    head = source.read(8)
    return source.read(struct.unpack("<q", head)[0]) if len(head) == 8 else None


def serve() -> None:
    """The child's side. What the parser prints goes to the error stream, so that it can't be taken for an answer."""
    source, to = sys.stdin.buffer, os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)
    function = pickle.loads(take(source))
    put(to, b"ready")
    while (message := take(source)) is not None:
        try:
            answer = (True, list(function(*pickle.loads(message))))
        except Exception as broken:
            answer = (False, f"{type(broken).__name__}: {broken}")
        put(to, pickle.dumps(answer, protocol=5))
