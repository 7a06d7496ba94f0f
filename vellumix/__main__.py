"""Commands: ``translate-md`` for Markdown files, ``run`` for PDF files or a list of URLs, ``serve`` for files as they arrive."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellumix import settings
from vellumix.errors import ConverterError, PipelineError, TranslateError, exit_code
from vellumix.operators import jobs, translate
from vellumix.plans import pipeline
from vellumix.sources import files, services


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vellumix")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("translate-md", "run", "serve"):
        own = commands.add_parser(name)
        source = own.add_mutually_exclusive_group(required=True) if name == "run" else own
        source.add_argument("--in", dest="source", help="a folder of files", required=name != "run")
        if name == "run":
            source.add_argument("--urls", help="a text file of URLs, one a line")
        own.add_argument("--out", required=True)
        own.add_argument("--env", default=".env", help="settings file")
        if name == "serve":
            own.add_argument("--once", action="store_true", help="end when all files that are there are done")
        own.add_argument("--fake", action="store_true", help="mark texts instead of sending them to a model")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        own = settings.load(Path(args.env).read_text().splitlines() if Path(args.env).exists() else [], online=not args.fake)
        spark = spark or SparkSession.builder.getOrCreate()
        translator = services.translator(own, args.fake)
        options = {"most": own.chunk_chars, "mode": own.symbol_fix_mode} | {"cache": None if args.fake else translate.Cache(own.cache_dir, own.llm_model, translate.fingerprint(services.PROMPT))}
        if args.command == "translate-md":
            failed = pipeline.translated_markdown(spark, args.source, args.out, translator, **options).where("error IS NOT NULL")
            if not failed.isEmpty():
                raise TranslateError(failed.first().error)
            return 0
        options["copies"] = own.jobs_dir
        convert = services.command_converter(own.converter_command, own.force_ocr)
        texts, log_path = f"{args.out.rstrip('/')}/.texts", f"{args.out.rstrip('/')}/.log"
        if args.command == "serve":
            pipeline.run_stream(spark, args.source, convert, translator, texts, log_path, f"{args.out.rstrip('/')}/.checkpoint", forever=not args.once, **options)
            log = spark.read.schema(pipeline.EVENTS).parquet(log_path)
            texts += "/batch-*"
        elif args.urls:
            urls = spark.read.text(args.urls).where("trim(value) <> ''").select(F.trim("value").alias("url"))
            log = pipeline.translated_urls(urls, services.http_fetch, convert, translator, texts, **options)
        else:
            log = pipeline.translated_files(files.read_binary(spark, args.source), convert, translator, texts, **options)
        files.export(spark.read.schema("name string, text string").parquet(texts), args.out)
        failed = jobs.latest(log).where("status = 'failed'").count()
        if failed:
            raise ConverterError(f"{failed} jobs failed")
        return 0
    except PipelineError as e:
        print(e, file=sys.stderr)
        return exit_code(e)


if __name__ == "__main__":
    sys.exit(main())
