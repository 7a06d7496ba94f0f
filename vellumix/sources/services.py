"""Callables for real services: HTTP downloads and an OpenAI-style chat endpoint."""

from __future__ import annotations

import codecs
import json
import shutil
import subprocess
import sys
import tempfile
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from vellumix.errors import ConfigError, ConverterError
from vellumix.settings import Settings

#: What a translation request asks for, unless the caller says otherwise.
PROMPT = (
    "Translate academic text into Simplified Chinese, close to the source's wording. Formulas, names of variables and sets, "
    "and tokens such as [[MATH_0001]] stay exactly as they are. Answer with the translation alone."
)


def http_fetch(url: str, timeout_s: float = 30.0) -> tuple[str, bytes]:
    """Content type and bytes behind a URL, redirects followed."""
    with urllib.request.urlopen(url, timeout=timeout_s) as answer:  # noqa: S310
        return answer.headers.get("Content-Type", ""), answer.read()


def chat(settings: Settings, timeout_s: float = 60.0, prompt: str = PROMPT) -> Callable[[str], str]:
    """A function that sends a text to the configured model and returns its answer."""
    if not (settings.llm_api_key and settings.llm_base_url and settings.llm_model):
        raise ConfigError("the model's key, address and name are needed")

    def call(text: str) -> str:
        body = {"model": settings.llm_model, "temperature": 0, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": text}]}
        request = urllib.request.Request(  # noqa: S310
            settings.llm_base_url.rstrip("/") + "/chat/completions",
            json.dumps(body).encode(),
            {"Authorization": f"Bearer {settings.llm_api_key}", "Content-Type": "application/json"},
        )
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:  # noqa: S310
            return json.load(answer)["choices"][0]["message"]["content"]

    return call


def translator(settings: Settings, fake: bool = False):
    """The translator that the settings name; a ConfigError where they name none. ``fake`` only marks texts."""
    from vellumix.operators import markdown, translate

    return markdown.fake if fake else translate.service(chat(settings), settings.retry_attempts, errors=True)


def resolve_command(command: str, folders: Iterable[str] = ()) -> str:
    """The program behind a name: on the search path, as a path, beside the interpreter, in ``folders``; else the name itself."""
    places = [command, *(str(Path(folder, command)) for folder in (Path(sys.executable).parent, *folders))]
    return next((found for place in dict.fromkeys(places) if (found := shutil.which(place))), command)


def run_shown(args: list[str], keep: int = 8000) -> tuple[int, str]:
    """Run a program and show what it says as it says it; its exit code and the last ``keep`` characters."""
    try:
        own = subprocess.Popen(args, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, bufsize=0)  # noqa: S603
    except OSError as e:
        raise ConverterError(f"{args[0]}: {e}") from e
    said, decoder = "", codecs.getincrementaldecoder("utf-8")("replace")
    while data := own.stdout.read(4096):  # whatever there is
        text = decoder.decode(data)
        sys.stdout.write(text)
        sys.stdout.flush()
        said = (said + text)[-keep:]
    return own.wait(), said


def command_converter(command: str, force_ocr: bool = False) -> Callable[[bytes], str]:
    """A converter that runs ``command`` on each PDF, in a folder of its own that goes afterwards."""

    def convert(content: bytes) -> str:
        with tempfile.TemporaryDirectory() as folder:
            source, out = Path(folder, "source.pdf"), Path(folder, "out")
            source.write_bytes(content)
            args = [resolve_command(command), str(source), "--output_dir", str(out), "--output_format", "markdown", *["--force_ocr"] * force_ocr]
            code, tail = run_shown(args)
            if code:
                raise ConverterError(tail)
            if not (found := sorted(out.rglob("*.md"))):
                raise ConverterError("the converter wrote no Markdown")
            return found[0].read_text(encoding="utf-8")

    return convert
