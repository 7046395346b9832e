"""Model providers: a protocol, and a deterministic one that works without a network."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

from .functions.vectors import hash_vector


class Provider(Protocol):
    """What tasks call; an object of it is sent to them, so it must pickle."""

    def name(self) -> str: ...
    def model_id(self) -> str: ...
    def batch_ceiling(self) -> int: ...
    def complete(self, prompt: str, json_mode: bool = False, max_tokens: int = 2048, temperature: float = 0.0) -> str: ...
    def embed(self, text: str) -> list[float]: ...
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class OfflineProvider:
    """Hash embeddings; entities are capitalised names in the prompt's text, related to the name met
    before, and a claim is a sentence about the first name in it."""

    NAME = re.compile(r"\b[A-ZÀ-Ý][\w'-]{2,}(?:\s+[A-ZÀ-Ý][\w'-]{2,})*")

    def __init__(self, dims: int = 128, most: int = 8):
        self.dims, self.most = dims, most

    def name(self) -> str:
        return "offline"

    def model_id(self) -> str:
        return f"hash-{self.dims}"

    def batch_ceiling(self) -> int:
        return 2048

    def embed(self, text: str) -> list[float]:
        return hash_vector(text, self.dims)

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def complete(self, prompt: str, json_mode: bool = False, max_tokens: int = 2048, temperature: float = 0.0) -> str:
        task, _, text = prompt.partition("\n")
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]
        if task == "ENTITIES":
            entities: dict[str, dict] = {}
            relations, before = [], None
            for s in sentences:
                names = list(dict.fromkeys(self.NAME.findall(s)))[: self.most]
                for n in names:
                    entities.setdefault(n, {"name": n, "type": "concept", "description": s[:200]})
                # Names are related to the one before them, within a sentence and from one to the next.
                chain = [*([before] if before else []), *names]
                relations += [{"source": a, "target": b, "predicate": "mentioned with", "description": s[:200], "weight": 1.0} for a, b in zip(chain, chain[1:], strict=False) if a != b]
                before = chain[-1] if chain else None
            return json.dumps({"entities": list(entities.values()), "relationships": relations})
        if task == "CLAIMS":
            claims = [{"entity_name": n[0], "claim": s[:300], "status": "pending"} for s in sentences if (n := self.NAME.findall(s))]
            return json.dumps({"claims": claims[: self.most]})
        if task == "STRUCTURE":
            return json.dumps({"summary": text[:200], "sections": len(sentences)})
        if task == "REPORT":
            return f"TITLE: {sentences[0][:80] if sentences else 'Community'}\nSUMMARY: {' '.join(sentences[:3])[:500]}"
        return f"answer {hashlib.sha256(prompt.encode()).hexdigest()[:12]}"


def provider_for(default: Provider, overrides: dict[str, Provider | None], project: str | None) -> Provider:
    """A project's own provider, or the default."""
    return overrides.get(project or "") or default
