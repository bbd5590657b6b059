"""A planner that asks a chat server, over an exchangeable transport."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from tabguard.plans.planner import PlannerError

#: What a transport takes: a path, and the JSON to post (None: get); it returns JSON.
Transport = Callable[[str, dict | None], dict]


class Chat:
    """Chat(...)(prompt) is the reply of a chat server; it serves as planner, mapper's basis or judge."""

    def __init__(self, url: str = "http://127.0.0.1:11434", model: str | None = None, timeout: float = 120, transport: Transport | None = None, prefer: tuple[str, ...] = ()):
        self.url, self.chosen, self.timeout, self.prefer = url.rstrip("/"), model, timeout, prefer
        self.transport = transport or self._http

    def _http(self, path: str, payload: dict | None) -> dict:
        data = None if payload is None else json.dumps(payload).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(reply.read())
        except (OSError, ValueError) as e:
            raise PlannerError(f"the chat server at {self.url} doesn't answer: {e}") from e

    def available(self) -> bool:
        try:
            self.transport("/api/tags", None)
        except PlannerError:
            return False
        return True

    def model(self) -> str:
        """The model given, else the first installed one of a preferred family, else the first one that can chat."""
        if self.chosen is None:
            have = [m.get("model") or m.get("name") or "" for m in self.transport("/api/tags", None).get("models", [])]
            have = [m for m in have if m and "embed" not in m]
            if not have:
                raise PlannerError("the chat server has no model installed")
            self.chosen = next((m for f in self.prefer for m in have if m.lower().startswith(f)), have[0])
        return self.chosen

    def __call__(self, prompt: str) -> str:
        payload = {"model": self.model(), "messages": [{"role": "user", "content": prompt}], "stream": False, "options": {"temperature": 0}}
        try:
            reply = self.transport("/api/chat", payload)
        except PlannerError:  # once more: a local server may be busy loading
            reply = self.transport("/api/chat", payload)
        return reply.get("message", {}).get("content") or ""

    def value(self, prompt: str) -> str:
        """One value as {"value": ...}; empty if the reply has none."""
        from tabguard.plans.planner import json_call

        try:
            found = json_call(self, f'{prompt}\nReply with {{"value": ...}} only.')
        except PlannerError:
            return ""
        return str(found.get("value", "")) if isinstance(found, dict) else ""
