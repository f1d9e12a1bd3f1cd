"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, which a template renders."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and of other usual templates.  None has a backslash.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>")
TRAINED = "assistant"  # the role under the loss mask


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths with their kinds; elements of a list share the path ``[]``, and nulls have none."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()), set())
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value), {f"{at}[]"})
    return set() if value is None else {f"{at}:{'text' if isinstance(value, str) else 'other'}"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How records of some layout become turns.

    Either ``each`` names a list of messages with fields ``role`` and ``text``, or ``turns`` lists (role, fields):
    the texts of those fields that are there, joined by an empty line, make a turn, none if no field is there.
    A role that begins with ``@`` is the field's value.  ``roles`` renames roles.  ``required`` and ``optional`` are
    the field paths of the layout; its fingerprints are those of ``required`` with any of ``optional``.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> set[str]:
        some = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return {fingerprint({*self.required, *more}) for more in some}

    def apply(self, record: dict) -> list[tuple[str, str]]:
        names = dict(self.roles)
        if self.each:
            found = [(m.get(self.role) or "", m.get(self.text) or "") for m in record.get(self.each) or [] if m]
        else:
            found = []
            for role, fields in self.turns:
                texts = [record[f] for f in fields if record.get(f) is not None]
                if texts or role[0] == "@":
                    found.append((record.get(role[1:]) or "" if role[0] == "@" else role, "\n\n".join(texts)))
        return [(names.get(role, role), text) for role, text in found]


_USUAL = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Layouts that are known from the start; callers may add theirs.
MAPPINGS = (
    Mapping("turn rows", (), ("role:text", "text:text"), turns=(("@role", ("text",)),)),
    Mapping("messages", ("messages[]",), ("messages[].role:text", "messages[].content:text", "id:text", "id:other"), each="messages", roles=_USUAL),
    Mapping("conversations", ("conversations[]",), ("conversations[].from:text", "conversations[].value:text", "id:text", "id:other"), each="conversations", role="from", text="value", roles=_USUAL),
    Mapping("instruction", ("instruction:text", "output:text"), ("system:text", "input:text"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt", ("prompt:text",), ("system:text", "completion:text", "response:text"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion", "response")))),
    Mapping("question", ("question:text", "answer:text"), ("context:text",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of records (``conv_id``, ``seq``, ``payload``: a JSON object of any layout), in the order ``seq``, ``place``.

    Columns: conv_id, seq, place, role, text, fingerprint, layout.  A payload that is null, no JSON object, or of a
    layout without a mapping gives one row with null layout, role and text, so that nothing is lost unseen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {f: m for m in mappings for f in m.fingerprints()}
        for batch in batches:
            at, rows = [], []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                try:
                    record = json.loads(payload or "null")
                except ValueError:
                    record = None
                mark = fingerprint(field_paths(record)) if isinstance(record, dict) else None
                mapping = known.get(mark)
                turns = mapping.apply(record) if mapping else [(None, None)]
                for place, (role, text) in enumerate(turns):
                    at.append(i)
                    rows.append((place, role, text, mark, mapping and mapping.name))
            index = pa.array(at, pa.int64())
            names, kinds = ("place", "role", "text", "fingerprint", "layout"), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(index), batch.column("seq").take(index), *columns], ["conv_id", "seq", *names])

    kind = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    return records.select("conv_id", "seq", "payload").mapInArrow(run, f"conv_id {kind['conv_id']}, seq {kind['seq']}, place bigint, role string, text string, fingerprint string, layout string")


def escape(text: F.Column) -> F.Column:
    """Doubles backslashes and puts one after the first character of each control string; a lone backslash is always ours."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds to turns their ``formatted`` piece, and ``loss_from`` and ``loss_to``, the characters in it under the loss mask.

    A conversation's pieces one after another are its formatted text.  A newline in a role is escaped, too.  Null roles
    and texts are empty.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    trained = F.coalesce(F.col("role") == TRAINED, F.lit(False))
    return turns.withColumns({
        "formatted": F.concat(head, text, F.lit(END + "\n")),
        "loss_from": F.when(trained, F.char_length(head)).otherwise(0).cast("bigint"),
        "loss_to": F.when(trained, F.char_length(head) + F.char_length(text)).otherwise(0).cast("bigint"),
    })


_HEAD = re.compile(re.escape(START) + r"((?:\\.|[^\\\n])*)\n", re.DOTALL)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of formatted text."""
    at = 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = formatted.index(END, head.end())
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + len(END) + 1


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text holds: number and digest of turns, and of the text under the loss mask.

    Pieces are dealt out by conversation and sorted, and each task reads them as a stream, so that a conversation
    with a large part of all turns takes no more memory than a short one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        open_id, state = None, None

        def done() -> pa.RecordBatch:
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([open_id, pa.array([n]), pa.array([turns.hexdigest()]), pa.array([chars]), pa.array([loss.hexdigest()]), pa.array([size])], ["conv_id", *names])

        for batch in batches:
            ids = batch.column("conv_id")
            for i, (formatted, begin, end) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("formatted", "loss_from", "loss_to")), strict=True)):
                if state is None or ids[i].as_py() != open_id[0].as_py():
                    if state is not None:
                        yield done()
                    open_id, state = ids.slice(i, 1), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(formatted[begin:end])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
        if state is not None:
            yield done()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    pieces = formatted.select("conv_id", "seq", "place", "role", "text", "formatted", "loss_from", "loss_to")
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place", "role", "text").drop("text")
    return pieces.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """One row for each conversation with its whole ``formatted`` text, for use with conversations that fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "place", "role", "text", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["formatted"]), "").alias("formatted"))


def records(rows: DataFrame, most: int = 8) -> DataFrame:
    """Conversations (``conv_id``, ``turn``, ``role``, ``text``) as payloads of the layouts that data sets come in, by a hash of the id.

    One of up to ``most`` rows, with no role that a layout renames, is one record: a list of messages in either naming or, if it is one user's and one
    assistant's turn (after a system's), an instruction, prompt or question.  A longer one has a record for each
    row, so that no group of unbounded size is put together.  Rows of one turn number go by role and text.
    """
    some = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    renamed = F.coalesce(F.col("role").isin(*dict(_USUAL)), F.lit(False))  # a name that lists of messages give another role to
    short = rows.where("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n"), F.max(renamed).alias("renamed")).where((F.col("n") <= most) & ~F.col("renamed")).select("conv_id")
    single = rows.join(short, "conv_id", "left_anti").withColumn("kind", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    usual = F.coalesce("role", F.lit("")).isin("user", "assistant", "system")
    named = {"user": "human", "assistant": "gpt"}
    from_name = lambda role: F.coalesce(F.create_map(*(F.lit(x) for pair in named.items() for x in pair))[role], role)
    value = lambda role, text: F.struct(from_name(role).alias("from"), text.alias("value"))
    content = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    payload = F.when((F.col("kind") == 0) & ~renamed, F.to_json(F.struct(F.array(content(role, text)).alias("messages"))))
    payload = payload.when((F.col("kind") == 1) & usual, F.to_json(F.struct(F.array(value(role, text)).alias("conversations"))))
    payload = payload.otherwise(F.to_json(F.struct("role", "text")))
    by_row = single.select("conv_id", F.col("turn").alias("seq"), payload.alias("payload"))

    whole = rows.join(short, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *some))).alias("turns"))
    turns, kind = F.col("turns"), F.pmod(F.xxhash64("conv_id"), F.lit(5))
    roles = F.transform(turns, lambda x: x["role"])
    system = F.when(F.get(roles, F.lit(0)) == "system", F.get(turns, F.lit(0))["text"])
    at = F.when(system.isNull(), 0).otherwise(1)
    user, assistant = F.get(turns, at)["text"], F.get(turns, at + 1)["text"]
    pair = (F.size(turns) == at + 2) & (F.get(roles, at) == "user") & (F.get(roles, at + 1) == "assistant")
    payload = F.when(pair & (kind == 0), F.to_json(F.struct(system.alias("system"), user.alias("instruction"), assistant.alias("output"))))
    payload = payload.when(pair & (kind == 1), F.to_json(F.struct(system.alias("system"), user.alias("prompt"), assistant.alias("completion"))))
    payload = payload.when(pair & (kind == 2) & system.isNull(), F.to_json(F.struct(user.alias("question"), assistant.alias("answer"))))
    payload = payload.when((kind < 4) & F.forall(roles, lambda x: x.isin("user", "assistant", "system")), F.to_json(F.struct(F.transform(turns, lambda x: value(x["role"], x["text"])).alias("conversations"))))
    payload = payload.otherwise(F.to_json(F.struct(F.transform(turns, lambda x: content(x["role"], x["text"])).alias("messages"))))
    return by_row.unionByName(whole.select("conv_id", F.lit(0).cast(rows.schema["turn"].dataType).alias("seq"), payload.alias("payload")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, in the layouts of ``records``, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_turns(canonical_turns(records(rows.unionByName(extra)))))


def _sql_escape(text: str) -> str:
    text = f"replace({text}, '\\', '\\\\')"
    for mark in CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return text


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace({_sql_escape("role")}, chr(10), chr(10) || chr(10)))
      + length({_sql_escape("text")}) + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
