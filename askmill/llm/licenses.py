"""Licences by their sentences, in built-in functions only.

A text is cut into sentences, each is normalised, and a known one is replaced by
its identifier. The sequence of identifiers is matched against ordered rules: a
rule names a licence and the identifiers that must follow each other.

A text is cut at line breaks and at ``.``, ``!``, ``?``, ``;`` or ``:`` before a
blank. A known sentence is any run of whole pieces that holds its words, so it is
found on a line of its own, wrapped over lines, or both kinds in one text.

A null or empty text has no licence. Repeated rows and null ids stay. An empty
table gives an empty table. Texts are read whole. Other columns stay, except
those that are named like an output column, which is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = ["sentence_ids", "n_known", "licence"]

#: Stands in a sentence for a name of one to twelve words.
HOLDER = "zzholder"
#: Sentences of public licences and of usual notices, by identifier.
SENTENCES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-notice-3": "This project is licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights'
    " to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to"
    " whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
    " of the Software.",
    "mit-warranty": 'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited'
    " to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-notice-2": "Licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "Licensed under the GNU General Public License, version 2.",
    "lgpl3-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd3-notice": "Licensed under the BSD 3-Clause License.",
    "bsd2-notice": "Licensed under the BSD 2-Clause License.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc0-notice": "Licensed under CC0 1.0.",
    "reserved": "All rights reserved.",
    "mit-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action"
    " of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
    ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    **{
        f"{name}-grant": f"you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by"
        f" the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        for name, kind, version in (("gpl3", "", 3), ("gpl2", "", 2), ("lgpl3", "Lesser ", 3), ("agpl3", "Affero ", 3))
    },
    "gnu-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty"
    " of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": f"Neither the name of {HOLDER} nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    **{
        f"cc-{kind}-work": f"This work is licensed under a Creative Commons {title} 4.0 International License."
        for kind, title in (
            ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"),
            ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
        )
    },
    "cc0-waived": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or"
    " neighboring rights to this work.",
}

#: Rules in order, the first that matches names the licence.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("Apache-2.0", ("apache-grant", "apache-comply")),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL-2.0", ("gpl2-grant",)),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl3-notice-2",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("LGPL-3.0", ("lgpl3-notice",)),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("proprietary", ("reserved",)),
]


def normal(sentence: str) -> str:
    """What :func:`_normal` makes of a sentence, for the table of known ones."""
    lowered = sentence.translate(str.maketrans(_UPPER, _LOWER))
    return re.sub(r"[^a-z0-9.]+", " ", lowered).strip(" .")


def _normal(sentence: Column) -> Column:
    lowered = F.translate(sentence, _UPPER, _LOWER)
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9.]+", " "), F.lit(" ."))


def _parts(sentence: str) -> str:
    """A known sentence cut and normalised as :func:`_cut` does with a text."""
    return "\n".join(p for p in map(normal, re.sub("([.!?;:])[ \t\r]+", r"\1\n", sentence).split("\n")) if p)


def _cut(text: Column) -> Column:
    """The normalised pieces of a text, a line each; pieces end where lines or sentences do."""
    marked = F.regexp_replace(text, "([.!?;:])[ \t\r]+", "$1\n")
    return F.array_join(F.filter(F.transform(F.split(marked, "\n"), _normal), lambda s: F.length(s) > 0), "\n")


def _known(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text by their place; of two that begin at one place, the longer."""
    keys = {_parts(s).replace("\n", " "): name for name, s in sentences.items()}
    listed = sorted(keys, key=lambda k: (-len(k), k))
    forms = {k: k.replace(".", "[.]").replace(" ", "[ \n]").replace(HOLDER, "[a-z0-9.]+(?:[ \n][a-z0-9.]+){0,11}") for k in listed}
    pattern = "(?m)^(?:" + "|".join(forms.values()) + ")$"
    table = F.create_map(*[F.lit(v) for pair in keys.items() for v in pair])
    found = F.regexp_extract_all(_cut(text), F.lit(pattern), F.lit(0))
    named = [k for k in listed if HOLDER in k]
    return F.transform(
        found,
        lambda s: F.coalesce(
            F.element_at(table, F.translate(s, "\n", " ")), *[F.when(s.rlike(f"^(?:{forms[k]})$"), F.lit(keys[k])) for k in named]
        ),
    )


def with_licence(
    df: DataFrame, text: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None
) -> DataFrame:
    """Append ``sentence_ids`` (joined by commas), ``n_known`` and ``licence`` (null if no rule matches).

    ``sentences`` and ``rules`` are lists that people write; they are part of the plan.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    if len({_parts(s).replace("\n", " ") for s in sentences.values()}) < len(sentences):
        raise ValueError("two sentences are equal once they are normalised")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    passed = [F.col(f"`{c}`") for c in df.columns if c not in _OUT]
    read = df.select(*passed, _known(body, sentences).alias("__known"))
    listed = F.concat(F.lit(","), F.concat_ws(",", "__known"), F.lit(","))
    licence = F.coalesce(*[F.when(F.contains(listed, F.lit(f",{','.join(ids)},")), F.lit(name)) for name, ids in rules])
    return read.select(
        *passed, F.concat_ws(",", "__known").alias("sentence_ids"), F.size("__known").cast("bigint").alias("n_known"), licence.alias("licence")
    )
