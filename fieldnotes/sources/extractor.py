"""The extractor: a plug-in that answers prompts with JSON, a client for local chat servers, and an offline stand-in."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, StructType

from ..config import DEFAULT, Config, Pattern
from ..schemas import REPLY

#: (prompt, whether to ask for the reply's schema) to reply text.
Client = Callable[[str, bool], str]
ATTEMPTS = 3
BACK_OFF = 1.5


def parse(reply: str) -> dict:
    """The JSON object of a reply: all of it, else from its first brace to its last; an error if there is none."""
    try:
        found = json.loads(reply)
    except ValueError:
        m = re.search(r"\{.*\}", reply, re.S)
        if not m:
            raise ValueError("the reply has no JSON object") from None
        found = json.loads(m[0])
    if not isinstance(found, dict):
        raise ValueError("the reply is no JSON object")
    return found


def json_schema(kind: DataType) -> dict:
    """A data type as JSON schema; every field of an object is required."""
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": [f.name for f in kind.fields]}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": {"int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean"}.get(kind.simpleString(), "string")}


def chat(server: str, model: str, context: int = 32768, system: str = "", timeout: float = 600.0) -> Callable[[str, dict | str | None], str]:
    """(prompt, format) to reply text of a model behind a local chat server: JSON over HTTP at `/api/chat`, temperature 0."""

    def call(prompt: str, form: dict | str | None = None) -> str:
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        body = {"model": model, "messages": messages, "stream": False, "options": {"temperature": 0} | ({"num_ctx": context} if context > 0 else {})}
        request = urllib.request.Request(f"{server.rstrip('/')}/api/chat", json.dumps(body | ({"format": form} if form else {})).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)["message"]["content"].strip()

    return call


def chat_client(server: str, model: str, context: int = 32768, system: str = "") -> Callable[[], Client]:
    """Makes extractor clients that ask for the reply's schema, or for any JSON object where a server rejects schemas."""
    schema = StructType.fromDDL(REPLY).jsonValue()  # plain data, so that it travels to the tasks

    def make() -> Client:
        call, form = chat(server, model, context, system), json_schema(StructType.fromJson(schema))
        return lambda prompt, with_schema: call(prompt, form if with_schema else "json")

    return make


def ask(client: Client, prompt: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> str:
    """A reply that parses: with the schema first, else without; after a failure the prompt says what went wrong, and the next try waits longer."""
    said = prompt
    last: Exception | None = None
    for n in range(1, attempts + 1):
        for with_schema in (True, False):
            try:
                reply = client(said, with_schema)
                parse(reply)
                return reply
            except Exception as e:
                last = e
        if n < attempts:
            wait(BACK_OFF * n)
            said = f"{prompt}\n\nThe last reply could not be used ({last}). Answer with one JSON object only."
    raise RuntimeError(f"no usable reply after {attempts} attempts: {last}")


def extract(prompts: DataFrame, make: Callable[[], Client], attempts: int = ATTEMPTS) -> DataFrame:
    """Add reply and error to prompts (prompt, ...). One client per task; a prompt that fails is a row with an error."""
    names = [c for c in prompts.columns if c not in ("reply", "error")]

    def run(it: Iterator) -> Iterator:
        client = make()
        for pdf in it:
            replies, errors = [], []
            for p in pdf["prompt"]:
                try:
                    replies.append(ask(client, p, attempts))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(str(e))
            yield pdf.assign(reply=replies, error=errors)[[*names, "reply", "error"]]

    from pyspark.sql.types import StringType, StructField, StructType

    rows = prompts.select(*names)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("error", StringType())]))


_LINE = re.compile(r"^\[[^\]]*\] (\w+) \| ([^:]*): (.*)$", re.M)


def rule_based(config: Config = DEFAULT) -> Client:
    """A stand-in without a model, by rules of this library: customers' lines with a lexicon term become findings, flagged interviewer lines audit rows."""
    lexicon = {k: re.compile("(?i)" + "|".join(e.regex if isinstance(e, Pattern) else rf"\b{re.escape(e)}\b" for e in v)) for k, v in sorted(config.lexicon.items()) if v}
    want = re.compile("(?i)" + "|".join(config.want_patterns)) if config.want_patterns else None

    def client(prompt: str, with_schema: bool) -> str:
        del with_schema
        findings, audit = [], []
        led = False
        for role, speaker, said in _LINE.findall(prompt):
            if role == "INTERVIEWER":
                score = min(5, sum(r.weight for r in config.flag_rules if re.search(r.pattern, said) and ("?" in said or not r.question)))
                led = score > 0
                if led:
                    audit.append({"interviewer_speaker": speaker, "question_or_statement": said, "prompt_type": "feature_leading_question", "leading_score": score, "why_flagged": "rule", "better_neutral_rewrite": ""})
            elif role == "CUSTOMER" and (domain := next((k for k, p in lexicon.items() if p.search(said)), None)):
                wish = bool(want and want.search(said))
                findings.append(
                    {
                        "finding_type": "other" if wish else "pain_theme",
                        "domain_area": domain,
                        "theme_label": f"{domain} {'wish' if wish else 'problem'}",
                        "one_sentence_description": f"Speaks of {domain}.",
                        "customer_quote": said,
                        "customer_speaker": speaker,
                        "roles_affected": [],
                        "workflow_step": "",
                        "current_coping_or_workaround": "",
                        "consequence": "",
                        "evidence_strength": 2 if wish else 3,
                        "pain_severity": 3,
                        "urgency": 2,
                        "commercial_relevance": 2,
                        "customer_origin": "led_or_contaminated" if led else "spontaneous",
                        "interviewer_prompt_type": "feature_leading_question" if led else "open_discovery_question",
                        "leading_or_contaminated": led,
                        "contamination_notes": "",
                        "confidence": 0.5,
                    }
                )
        return json.dumps({"findings": findings, "interviewer_audit": audit})

    return client
