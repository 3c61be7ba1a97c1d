"""The additive template as a tokeniser, one id a code point: what an ``Adapter`` takes, without a vocabulary."""

from __future__ import annotations

from typing import Any

from tessera.functions.template import CODE_POINTS, STOP_MARKS, Additive


class PointTokenizer:
    def __init__(self, template: Additive = CODE_POINTS):
        self.template = template
        self.pad_token_id, self.eos_token_id, self.unk_token_id = template.pad_id, template.eos_id, 1

    def text(self, messages: list[dict[str, str]], generate: bool) -> str:
        t = self.template
        turns = (f"{t.open}{m['role']}{t.middle}{m['content']}{t.close}{m['role'] if t.close_role else ''}{t.after_close}" for m in messages)
        return "".join(turns) + (t.generation if generate else "")

    def apply_chat_template(self, messages: list[dict[str, str]], *, tokenize: bool = True, add_generation_prompt: bool = False) -> Any:
        text = self.text(messages, add_generation_prompt)
        return {"input_ids": [[ord(c) for c in text]]} if tokenize else text

    def convert_tokens_to_ids(self, mark: str) -> int:
        """The marks that end a turn have the ids from 5 on."""
        return 5 + STOP_MARKS.index(mark) if mark in STOP_MARKS else self.unk_token_id
