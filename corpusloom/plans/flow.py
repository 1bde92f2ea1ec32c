"""Flows: YAML lists of blocks, bound to a table's schema and run as one chain of DataFrame operators.

A step has block_type, block_config, gen_kwargs, drop_columns and drop_duplicates. Everything a step names - columns,
templates, operations - is checked against the schema when the flow is bound, before any model is called. Model stages
are evaluated once each and written; all between them is one lazy plan.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from threading import Lock, local
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions import chat as chats
from corpusloom.functions import text as tx
from corpusloom.functions.template import TemplateError, compiled, prompt_text
from corpusloom.operators import columns, filters, models, reshape
from corpusloom.operators.parse import Parser, parse_rows
from corpusloom.operators.stages import observed

log = logging.getLogger("corpusloom")
log.setLevel(os.environ.get("LOG_LEVEL", "INFO").upper())
FLOWS = Path(__file__).parent.parent / "flows"


class FlowError(ValueError):
    """A flow that can't be read or bound."""


class EmptyResult(ValueError):
    """A step, or a whole flow, that gave no rows."""


class Metrics:
    """Rows of each step of a flow, added up over all jobs that ran it: in, out, and what could not be converted.

    They are observed by the jobs that write what steps made; no job is run for them.
    """

    def __init__(self):
        self.lock, self.waiting, self.steps = Lock(), local(), {}

    def watch(self, df: DataFrame, step: str, name: str, **counts: Column) -> DataFrame:
        """df, whose rows (of the conditions given, else all) are counted for a step by the next job that writes it."""
        seen = Observation()
        if not hasattr(self.waiting, "all"):
            self.waiting.all = []
        self.waiting.all.append((step, seen))
        return df.observe(seen, *([F.count(F.lit(1)).alias(name)] if not counts else [F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]))

    def pending(self) -> bool:
        return bool(getattr(self.waiting, "all", ()))

    def settle(self) -> None:
        """Takes the counts of this thread's steps, whose job has ended."""
        for step, seen in getattr(self.waiting, "all", ()):
            found = observed(seen)
            if found is None:
                log.warning("%s: its rows were not counted", step)
                continue
            with self.lock:
                own = self.steps.setdefault(step, {})
                for name, n in found.items():
                    own[name] = own.get(name, 0) + n
                said = dict(own)
            log.info("%s: %s", step, ", ".join(f"{k} {n}" for k, n in said.items()))
        self.waiting.all = []

    def forget(self) -> None:
        """Leaves what waits, after a job that failed."""
        self.waiting.all = []

    def table(self) -> list[dict]:
        """step, rows_in, rows_out, dropped, unconverted, in the order of the steps."""
        return [{"step": s, "rows_in": n.get("rows_in", 0), "rows_out": n.get("rows_out", 0), "dropped": max(0, n.get("rows_in", 0) - n.get("rows_out", 0)), "unconverted": n.get("unconverted", 0)} for s, n in self.steps.items()]


@dataclass(frozen=True)
class Context:
    """What steps share: the model backend, where configuration files are, and how to treat missing columns and order.

    missing: what a template's missing column is: "error", "empty" text or, where there is a quarantine, "quarantine" for all rows.
    scope: columns by whose values rows belong together; majority and keep-first never look beyond. store: answers that
    are not asked for again. quarantine: where rows go that a model step can't do; without one they fail the job.
    metrics: gets the rows of each step.
    """

    backend: models.Backend | None = None
    base: Path = FLOWS
    order: Sequence[str] = ()
    missing: str = "error"
    scope: Sequence[str] = ()
    store: models.AnswerStore | None = None
    quarantine: models.Quarantine | None = None
    metrics: Metrics | None = None
    configs: Mapping[str, dict] = field(default_factory=dict)

    def config(self, path: str | None) -> dict | None:
        if path is None:
            return None
        if path in self.configs:
            return self.configs[path]
        return read_yaml(resolve(path, self.base))


@dataclass(frozen=True)
class Step:
    block_type: str
    config: dict[str, Any]
    gen_kwargs: dict[str, Any] = field(default_factory=dict)
    drop_columns: Sequence[str] = ()
    drop_duplicates: Sequence[str] = ()

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> Step:
        unknown = set(raw) - {"block_type", "block_config", "gen_kwargs", "drop_columns", "drop_duplicates"}
        if unknown or "block_type" not in raw:
            raise FlowError(f"a step needs block_type, and has no {', '.join(sorted(unknown)) or 'other keys'}")
        return cls(raw["block_type"], dict(raw.get("block_config") or {}), dict(raw.get("gen_kwargs") or {}), tuple(raw.get("drop_columns") or ()), tuple(raw.get("drop_duplicates") or ()))

    @property
    def name(self) -> str:
        return self.config.get("block_name", self.block_type)


Block = Callable[[DataFrame, dict, dict, Context], DataFrame]
BLOCKS: dict[str, Block] = {}


def block(*names: str):
    """Registers a block under its names: a function of the table, block_config, gen_kwargs and context."""

    def register(f: Block) -> Block:
        for n in names:
            BLOCKS[n] = f
        return f

    return register


def resolve(path: str, base: Path) -> Path:
    """A file of the package first, else the path as it is."""
    return base / path if (base / path).is_file() else Path(path)


def read_yaml(path: Path | str):
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def read_flow(path: str | Path, base: Path = FLOWS) -> list[Step]:
    raw = read_yaml(resolve(str(path), base))
    if not isinstance(raw, list):
        raise FlowError(f"{path}: a flow is a list of steps")
    return bound_names([Step.of(s) for s in raw])


def bound_names(steps: Sequence[Step]) -> list[Step]:
    for s in steps:
        if s.block_type not in BLOCKS:
            raise FlowError(f"no block {s.block_type}; there are {', '.join(sorted(BLOCKS))}")
    return list(steps)


#: Blocks whose result is written, and so counted.
MODELS = {"LLMBlock", "ConditionalLLMBlock", "LLMLogProbBlock", "LLMMessagesBlock", "PRMBlock"}
#: Blocks that give rows for rows.
SAME = {"RenameColumns", "DuplicateColumns", "CombineColumnsBlock", "SelectorBlock", "SamplePopulatorBlock", "SetToMajorityValue", "PostProcessThinkingBlock"}


def apply_step(df: DataFrame, step: Step, context: Context, label: str | None = None) -> DataFrame:
    config = {k: v for k, v in step.config.items() if k not in ("block_name", "batch_kwargs")}
    label, metrics = label or step.name, context.metrics
    if metrics:
        df = metrics.watch(df, label, "rows_in")
    config["block_name"] = label
    out = BLOCKS[step.block_type](df, config, step.gen_kwargs, context)
    out = columns.drop(out, [c for c in step.drop_columns if c not in context.scope])
    lost = [c for c in context.scope if c not in out.columns]
    if lost:
        raise FlowError(f"step {step.name} loses {', '.join(lost)}, by which rows belong together")
    if step.drop_duplicates:
        out = reshape.first_per_key(out, [*dict.fromkeys([*context.scope, *step.drop_duplicates])], [c for c in context.order if c in out.columns] or None)
    return metrics.watch(out, label, "rows_out") if metrics else out


def asks(step: Step) -> bool:
    """Whether a step calls a model."""
    return step.block_type in MODELS or step.block_type == "IterBlock" and asks(Step(step.config["block_type"], step.config.get("block_kwargs") or {}))


def generate(df: DataFrame, steps: Sequence[Step], context: Context | None = None, fail_on_empty: bool = True) -> DataFrame:
    """The rows a flow makes of df.

    A step without rows is an error, found where a model step's result is written, whose job counts it: no model is
    called on nothing, and no job is run to look. With fail_on_empty=False a flow without rows gives none.
    """
    context = context or Context()
    try:
        return _generated(df, bound_names(steps), context, fail_on_empty)
    finally:
        if context.metrics:
            context.metrics.forget()  # of a job that failed


def _generated(df: DataFrame, steps: Sequence[Step], context: Context, fail_on_empty: bool) -> DataFrame:
    some = False  # whether it is known that there are rows
    for k, step in enumerate(steps):
        given = Observation()
        if asks(step):
            df = df.observe(given, F.count(F.lit(1)).alias("rows"))
        df = apply_step(df, step, context, f"{k + 1} {step.name}")
        if asks(step):
            df, made = written_step(df, context)
            if fail_on_empty and not made:
                raise EmptyResult(f"step {step.name} gave no rows" if (observed(given) or {}).get("rows") else f"there are no rows for step {step.name}")
            some = made > 0
        else:
            some = some and step.block_type in SAME
    if context.metrics and context.metrics.pending():
        df, made = written_step(df, context)
    else:
        made = int(some or not fail_on_empty or not df.isEmpty())
    if fail_on_empty and not made:
        raise EmptyResult("the flow gave no rows")
    return df


def written_step(df: DataFrame, context: Context) -> tuple[DataFrame, int]:
    """df, written, and the number of its rows."""
    out, counts = models.evaluated(df)
    if context.metrics:
        context.metrics.settle()
    return out, counts["rows"]


def _words(x: Any) -> set[str]:
    """All strings in a configuration."""
    if isinstance(x, str):
        return {x}
    inner = [*x, *x.values()] if isinstance(x, Mapping) else x if isinstance(x, (list, tuple)) else []
    return set().union(*map(_words, inner))


def scoped(context: Context, flows: Sequence[Sequence[Step]], names: Sequence[str]) -> tuple[Context, str]:
    """The context with one more column of the scope, and its name: no step names it, so all carry it to the end.

    A step that keeps the columns it does not know, as all of a flow do, carries it by itself; one that loses it is an error.
    """
    taken = [w for steps in flows for s in steps for w in _words([s.config, s.drop_columns, s.drop_duplicates])]
    name = columns.unused("_batch", [*names, *taken])
    return replace(context, scope=(*context.scope, name)), name


@block("RenameColumns")
def _rename(df, config, _, __):
    return columns.rename(df, config["columns_map"])


@block("DuplicateColumns")
def _duplicate(df, config, _, __):
    return columns.duplicate(df, config["columns_map"])


@block("CombineColumnsBlock")
def _combine(df, config, _, __):
    return columns.combine(df, config["columns"], config["output_col"], config.get("separator", "\n\n"), config.get("strict", False))


@block("SelectorBlock")
def _select(df, config, _, __):
    return columns.select_by(df, config["choice_map"], config["choice_col"], config["output_col"])


@block("SamplePopulatorBlock")
def _populate(df, config, _, context):
    post = f"_{config['post_fix']}" if config.get("post_fix") else ""
    paths = [p if not post else str(Path(p).with_name(f"{Path(p).stem}{post}{Path(p).suffix}")) for p in config["config_paths"]]
    return columns.populate(df, {Path(given).stem: context.config(p) for given, p in zip(config["config_paths"], paths, strict=True)}, config["column_name"])


@block("FilterByValueBlock")
def _filter(df, config, _, context):
    convert = config.get("convert_dtype")
    if convert and context.metrics:
        name, c = convert if isinstance(convert, str) else convert.__name__, config["filter_column"]
        df = context.metrics.watch(df, config.get("block_name", "filter"), "", unconverted=F.col(f"`{c}`").isNotNull() & filters.CONVERTERS[name](c).isNull())
    return filters.filter_by_value(df, config["filter_column"], config["filter_value"], config["operation"], convert if convert is None or isinstance(convert, str) else convert.__name__)


@block("FlattenColumnsBlock")
def _flatten(df, config, _, __):
    return reshape.flatten(df, config["var_cols"], config["value_name"], config["var_name"])


@block("SetToMajorityValue")
def _majority(df, config, _, context):
    return reshape.majority(df, config["col_name"], [c for c in context.scope if c in df.columns])


@block("PostProcessThinkingBlock")
def _thinking(df, config, _, __):
    return df.withColumn(config["column_name"], tx.after_marker(config["column_name"]))


@block("RegexParserBlock")
def _regex(df, config, _, __):
    cleanup = config.get("parser_cleanup_tags") or ()
    if config.get("parsing_pattern"):
        return parse_rows(df, config["column_name"], Parser(config["output_cols"], pattern=config["parsing_pattern"], cleanup=cleanup, clean_all=True))
    return df.withColumns({c: tx.without(c, cleanup) for c in config.get("output_cols") or ()})


@block("IterBlock")
def _iterate(df, config, gen, context):
    inner = Step(config["block_type"], dict(config["block_kwargs"]), {**gen, **(config.get("gen_kwargs") or {})})
    bound_names([inner])
    return reshape.iterate(df, config["num_iters"], lambda d: apply_step(d, inner, replace(context, metrics=None), config["block_name"]), "_iteration").drop("_iteration")


def _backend(context: Context) -> models.Backend:
    if context.backend is None:
        raise FlowError("a model step needs a backend")
    return context.backend


def _parser(config: dict, prompt: dict | None) -> Parser:
    given = config.get("parser_kwargs") or {}
    if given.get("parser_name") == "custom":
        return Parser(config["output_cols"], pattern=given["parsing_pattern"], cleanup=given.get("parser_cleanup_tags") or ())
    prompt = prompt or {}
    return Parser(config["output_cols"], prompt.get("start_tags") or (), prompt.get("end_tags") or ())


def _template(config: dict) -> str:
    name = config.get("model_prompt")
    if name and ("{prompt}" in name or name in chats.TEMPLATES):
        return name
    if name:
        raise FlowError(f"no chat template {name}; there are {', '.join(sorted(chats.TEMPLATES))}")
    if not config.get("model_id"):  # the server's own model: the prompt as it is
        return "blank"
    try:
        return chats.for_model(config["model_id"])
    except KeyError as e:
        raise FlowError(e.args[0]) from e


def _sampled(df: DataFrame, prompt: dict | None) -> DataFrame:
    """df with the prompt's number of samples, which its template may name."""
    n = (prompt or {}).get("num_samples")
    return df if n is None else df.withColumn("num_samples", F.lit(n))


def _usable(df: DataFrame, reason: Column | None, config: dict, context: Context) -> DataFrame:
    """The rows that a step can ask about; the others go to the quarantine. Without one there is no reason."""
    return df if reason is None or context.quarantine is None else context.quarantine.take(df, reason, config["block_name"])


def _compiled(df: DataFrame, prompt: dict | None, config: dict, context: Context) -> tuple[DataFrame, Column]:
    """The rows whose template can be rendered, and the rendering. A column that is missing is missing in all rows."""
    try:
        return df, compiled(prompt_text(prompt), df.schema, "error" if context.missing == "quarantine" else context.missing)
    except TemplateError as e:
        if context.missing != "quarantine" or context.quarantine is None:
            raise
        return _usable(df, F.lit(str(e)), config, context), F.lit("")


def _asked(df: DataFrame, config: dict, context: Context, call: Callable[[DataFrame, str | None], DataFrame]) -> DataFrame:
    """What a model is asked, evaluated once if there may be rows without an answer: those go to the quarantine."""
    if context.quarantine is None:
        return call(df, None)
    errors = columns.unused("_error", df.columns)
    made, n = models.evaluated(call(df, errors), errors=F.col(errors).isNotNull())
    return context.quarantine.take(made, F.col(errors), config["block_name"], n["errors"]).drop(errors)


def _completions(df: DataFrame, config: dict, gen: dict, context: Context, prompt, first: dict | None) -> DataFrame:
    asked, made = columns.unused("_prompt", df.columns), columns.unused("_completion", df.columns)
    call = lambda d, errors: models.complete(d.withColumn(asked, prompt), asked, made, _backend(context), models.Options.of(gen), config.get("model_id"), config["block_name"], errors, context.store).drop(asked)
    each = _asked(df, config, context, call).withColumn(made, F.explode(made))
    return parse_rows(each, made, _parser(config, first), keep=df.columns)


@block("LLMBlock")
def _model(df, config, gen, context):
    prompt = context.config(config["config_path"])
    df, text = _compiled(_sampled(df, prompt), prompt, config, context)
    return _completions(df, config, gen, context, chats.render(_template(config), text), prompt)


@block("ConditionalLLMBlock")
def _conditional(df, config, gen, context):
    prompts = {k: context.config(p) for k, p in config["config_paths"].items()}
    first = next(iter(prompts.values()))
    df = _sampled(df, first)
    selector, picked = F.col(config["selector_column_name"]), F
    if "All" not in prompts:
        known = F.coalesce(selector.isin(list(prompts)), F.lit(False))
        df = _usable(df, F.when(~known, F.concat(F.lit("no prompt for "), F.coalesce(selector.cast("string"), F.lit("null")))), config, context)
    for key, p in prompts.items():
        if key != "All":
            df, text = _compiled(df, p, config, context)
            picked = picked.when(selector == key, text)
    if "All" in prompts:
        df, rest = _compiled(df, prompts["All"], config, context)
    else:
        rest = F.raise_error(F.concat(F.lit("no prompt for "), F.coalesce(selector.cast("string"), F.lit("null")))).cast("string")
    text = rest if picked is F else picked.otherwise(rest)
    if config.get("wrap"):
        text = chats.render(_template(config), text)
    return _completions(df, config, gen, context, text, first)


@block("LLMLogProbBlock")
def _logprob(df, config, gen, context):
    df, text = _compiled(df, context.config(config["config_path"]), config, context)
    name = columns.unused("_prompt", df.columns)
    call = lambda d, errors: models.logprobs(d.withColumn(name, chats.render(_template(config), text)), name, config["output_cols"][0], _backend(context), models.Options.of(gen), config.get("model_id"), config["block_name"], errors, context.store).drop(name)
    return _asked(df, config, context, call)


@block("LLMMessagesBlock")
def _messages(df, config, gen, context):
    columns.need(df, [config["input_col"]])
    call = lambda d, errors: models.chat(d, config["input_col"], config["output_col"], _backend(context), models.Options.of(gen), config.get("model_id"), config["block_name"], errors, context.store)
    return _asked(df, config, context, call)


@block("PRMBlock")
def _rewards(df, config, _, context):
    columns.need(df, [config["prompt_col"], config["response_col"]])
    return models.rewards(df, config["prompt_col"], config["response_col"], _backend(context), config.get("output_col", "step_rewards"), config.get("system_prompt"), config.get("step_separator", "\n\n"), config.get("step_fill_token", "<extra_0>"), config.get("model_name"))
