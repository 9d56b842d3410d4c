"""License scans by ordered signature rules.

Base: places where a phrase's words stand consecutively among a text's words (runs of a-z, 0-9 and characters beyond
ASCII, A-Z lower-cased). Method: hand-written regexes over the lower-cased text in order of priority. Each is gated by
keywords: one automaton over all keywords reads a text once, and only the rules whose keyword occurs run. Of detections
that overlap, the one of higher priority stays: the stronger, then the longer, so that contained ones give way, then the
earlier rule. "GNU Lesser General Public License v2.1" is one detection, of lgpl-2.1; its base label gpl stands beside it.
Labels are the base labels and the labels of the detections that remain; score is the strength of the best of them.

Scale. One pass over the texts, no shuffle. Texts without any keyword (most) cost the automaton and a vectorised word
count only. Every regex has bounded gaps, so a scan is linear in the text.

Defined cases: null and empty texts have no words, empty label strings, null places and score 0; repeated rows give repeated
rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Kept, text_batches
from quarry.session import ship

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Hand-written rules in order of priority: label | strength | keyword | regex over the lower-cased text. In a regex a
#: space stands for white space, comment signs and line ends between words, and ~ for up to 60 characters of one line.
RULES = r"""
agpl-3.0-only | 1.0 | spdx | spdx-license-identifier: ?\(?agpl-3\.0-only\b
agpl-3.0-or-later | 1.0 | spdx | spdx-license-identifier: ?\(?agpl-3\.0(?:-or-later|\+)
agpl-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?agpl-3\.0\b
lgpl-2.0-only | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-2\.0(?:-only)?\b
lgpl-2.1-only | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-2\.1-only\b
lgpl-2.1-or-later | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-2\.1(?:-or-later|\+)
lgpl-2.1 | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-2\.1\b
lgpl-3.0-only | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-3\.0-only\b
lgpl-3.0-or-later | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-3\.0(?:-or-later|\+)
lgpl-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?lgpl-3\.0\b
gpl-2.0-only | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-2\.0-only\b
gpl-2.0-or-later | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-2\.0(?:-or-later|\+)
gpl-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-2\.0\b
gpl-3.0-only | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-3\.0-only\b
gpl-3.0-or-later | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-3\.0(?:-or-later|\+)
gpl-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-3\.0\b
gpl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?gpl-1\.0
apache-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?apache-2\.0\b
apache-1.1 | 1.0 | spdx | spdx-license-identifier: ?\(?apache-1\.1\b
apache-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?apache-1\.0\b
mit | 1.0 | spdx | spdx-license-identifier: ?\(?mit\b(?!-)
mit-0 | 1.0 | spdx | spdx-license-identifier: ?\(?mit-0\b
mit-modern | 1.0 | spdx | spdx-license-identifier: ?\(?mit-modern-variant\b
bsd-0 | 1.0 | spdx | spdx-license-identifier: ?\(?0bsd\b
bsd-1-clause | 1.0 | spdx | spdx-license-identifier: ?\(?bsd-1-clause\b
bsd-2-clause | 1.0 | spdx | spdx-license-identifier: ?\(?bsd-2-clause\b
bsd-2-clause-patent | 1.0 | spdx | spdx-license-identifier: ?\(?bsd-2-clause-patent\b
bsd-3-clause | 1.0 | spdx | spdx-license-identifier: ?\(?bsd-3-clause\b
bsd-3-clause-clear | 1.0 | spdx | spdx-license-identifier: ?\(?bsd-3-clause-clear\b
bsd-4-clause | 1.0 | spdx | spdx-license-identifier: ?\(?bsd-4-clause\b
mpl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?mpl-1\.0\b
mpl-1.1 | 1.0 | spdx | spdx-license-identifier: ?\(?mpl-1\.1\b
mpl-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?mpl-2\.0\b
epl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?epl-1\.0\b
epl-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?epl-2\.0\b
cddl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cddl-1\.0\b
cddl-1.1 | 1.0 | spdx | spdx-license-identifier: ?\(?cddl-1\.1\b
eupl-1.1 | 1.0 | spdx | spdx-license-identifier: ?\(?eupl-1\.1\b
eupl-1.2 | 1.0 | spdx | spdx-license-identifier: ?\(?eupl-1\.2\b
isc | 1.0 | spdx | spdx-license-identifier: ?\(?isc\b
zlib | 1.0 | spdx | spdx-license-identifier: ?\(?zlib\b
bsl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?bsl-1\.0\b
unlicense | 1.0 | spdx | spdx-license-identifier: ?\(?unlicense\b
wtfpl | 1.0 | spdx | spdx-license-identifier: ?\(?wtfpl\b
cc0-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc0-1\.0\b
cc-by-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-3\.0\b
cc-by-4.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-4\.0\b
cc-by-sa-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-sa-3\.0\b
cc-by-sa-4.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-sa-4\.0\b
cc-by-nc-4.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-nc-4\.0\b
cc-by-nc-sa-4.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-nc-sa-4\.0\b
cc-by-nd-4.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-nd-4\.0\b
cc-by-nc-nd-4.0 | 1.0 | spdx | spdx-license-identifier: ?\(?cc-by-nc-nd-4\.0\b
artistic-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?artistic-1\.0
artistic-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?artistic-2\.0\b
ofl-1.1 | 1.0 | spdx | spdx-license-identifier: ?\(?ofl-1\.1
python-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?python-2\.0\b
psf-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?psf-2\.0\b
postgresql | 1.0 | spdx | spdx-license-identifier: ?\(?postgresql\b
openssl | 1.0 | spdx | spdx-license-identifier: ?\(?openssl\b
ms-pl | 1.0 | spdx | spdx-license-identifier: ?\(?ms-pl\b
ms-rl | 1.0 | spdx | spdx-license-identifier: ?\(?ms-rl\b
upl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?upl-1\.0\b
ncsa | 1.0 | spdx | spdx-license-identifier: ?\(?ncsa\b
afl-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?afl-3\.0\b
osl-3.0 | 1.0 | spdx | spdx-license-identifier: ?\(?osl-3\.0\b
sspl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?sspl-1\.0\b
busl-1.1 | 1.0 | spdx | spdx-license-identifier: ?\(?busl-1\.1\b
odbl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?odbl-1\.0\b
pddl-1.0 | 1.0 | spdx | spdx-license-identifier: ?\(?pddl-1\.0\b
gfdl-1.3 | 1.0 | spdx | spdx-license-identifier: ?\(?gfdl-1\.3
gfdl-1.2 | 1.0 | spdx | spdx-license-identifier: ?\(?gfdl-1\.2
ecl-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?ecl-2\.0\b
vim | 1.0 | spdx | spdx-license-identifier: ?\(?vim\b
w3c | 1.0 | spdx | spdx-license-identifier: ?\(?w3c\b
x11 | 1.0 | spdx | spdx-license-identifier: ?\(?x11\b
ruby | 1.0 | spdx | spdx-license-identifier: ?\(?ruby\b
php-3.01 | 1.0 | spdx | spdx-license-identifier: ?\(?php-3\.01\b
zpl-2.1 | 1.0 | spdx | spdx-license-identifier: ?\(?zpl-2\.1\b
mulanpsl-2.0 | 1.0 | spdx | spdx-license-identifier: ?\(?mulanpsl-2\.0\b
agpl-3.0 | 0.95 | affero | gnu affero general public licen[sc]e~(?:version|v)\.? ?3
agpl-3.0-or-later | 0.95 | affero | gnu affero general public licen[sc]e~(?:version|v)\.? ?3~or \(?at your option\)? any later version
agpl | 0.9 | affero | (?:gnu )?affero general public licen[sc]e
lgpl-2.1 | 0.95 | lesser | (?:gnu )?lesser general public licen[sc]e~(?:version|v)\.? ?2\.1
lgpl-2.1-or-later | 0.95 | lesser | (?:gnu )?lesser general public licen[sc]e~(?:version|v)\.? ?2\.1~or \(?at your option\)? any later version
lgpl-3.0 | 0.95 | lesser | (?:gnu )?lesser general public licen[sc]e~(?:version|v)\.? ?3
lgpl-3.0-or-later | 0.95 | lesser | (?:gnu )?lesser general public licen[sc]e~(?:version|v)\.? ?3~or \(?at your option\)? any later version
lgpl | 0.9 | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl-2.0 | 0.95 | library | gnu library general public licen[sc]e~(?:version|v)\.? ?2
lgpl-2.0 | 0.9 | library | gnu library general public licen[sc]e
gpl-1.0 | 0.95 | general public | gnu general public licen[sc]e~(?:version|v)\.? ?1\b
gpl-2.0 | 0.95 | general public | (?:gnu )?general public licen[sc]e~(?:version|v)\.? ?2
gpl-2.0-or-later | 0.95 | general public | (?:gnu )?general public licen[sc]e~(?:version|v)\.? ?2~or \(?at your option\)? any later version
gpl-3.0 | 0.95 | general public | (?:gnu )?general public licen[sc]e~(?:version|v)\.? ?3
gpl-3.0-or-later | 0.95 | general public | (?:gnu )?general public licen[sc]e~(?:version|v)\.? ?3~or \(?at your option\)? any later version
gpl-2.0 | 0.95 | general public | version 2(?:\.0)? of the (?:gnu )?general public licen[sc]e
gpl-3.0 | 0.95 | general public | version 3(?:\.0)? of the (?:gnu )?general public licen[sc]e
gpl-2.0-or-later | 0.95 | later version | either version 2 of the license, or \(?at your option\)? any later version
gpl-3.0-or-later | 0.95 | later version | either version 3 of the license, or \(?at your option\)? any later version
gpl | 0.9 | general public | (?:gnu )?general public licen[sc]e
gpl | 0.7 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl\b
gpl-2.0 | 0.8 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?-?v?2
gpl-3.0 | 0.8 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?-?v?3
lgpl | 0.7 | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl\b
agpl | 0.7 | agpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?agpl\b
gpl | 0.9 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl\b
gpl-2.0 | 0.95 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | 0.95 | gnu.org | gnu\.org/licenses/gpl-3\.0
lgpl | 0.9 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl\b
lgpl-2.1 | 0.95 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | 0.95 | gnu.org | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | 0.95 | gnu.org | gnu\.org/licenses/agpl-3\.0
agpl | 0.9 | gnu.org | gnu\.org/licenses/agpl\b
gfdl | 0.9 | gnu.org | gnu\.org/licenses/fdl
gpl | 0.6 | free software | this program is free software[:;] you can redistribute it
gpl | 0.6 | merchantability | without even the implied warranty of merchantability or fitness
gpl | 0.6 | free software foundation | as published by the free software foundation
gfdl-1.3 | 0.95 | free documentation | gnu free documentation licen[sc]e~version 1\.3
gfdl-1.2 | 0.95 | free documentation | gnu free documentation licen[sc]e~version 1\.2
gfdl | 0.9 | free documentation | (?:gnu )?free documentation licen[sc]e
gpl-classpath-exception | 0.95 | classpath | gpl~classpath exception|classpath exception~gpl
apache-2.0 | 0.95 | apache | apache licen[sc]e,? \(?(?:version|v)\.? ?2(?:\.0)?
apache-2.0 | 0.95 | apache | apache software licen[sc]e,? \(?(?:version|v)\.? ?2(?:\.0)?
apache-2.0 | 0.95 | apache | apache[- ]2(?:\.0)? licen[sc]e
apache-2.0 | 0.95 | apache.org | apache\.org/licenses/license-2\.0
apache-1.1 | 0.95 | apache | apache (?:software )?licen[sc]e,? (?:version|v)\.? ?1\.1
apache-1.0 | 0.95 | apache | apache (?:software )?licen[sc]e,? (?:version|v)\.? ?1\.0
apache | 0.9 | apache | apache (?:software )?licen[sc]e
apache | 0.8 | apache.org | apache\.org/licenses\b
apache-2.0 | 0.7 | apache | (?:licensed|released|distributed|available) under (?:the )?apache(?:[- ]v?2(?:\.0)?)?\b
apache-2.0 | 0.8 | warranties | distributed on an "as is" basis, without warranties or conditions of any kind
apache-2.0 | 0.6 | compliance | you may not use this file except in compliance with the license
mit | 0.95 | mit | (?:released|licensed|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?mit(?:/x11)?(?:[- ]style)? licen[sc]e
mit | 0.9 | mit | mit licen[sc]e(?:d)?\b
mit | 0.9 | mit | \(the mit license\)
mit | 0.8 | mit | licen[sc]e: ?mit\b
mit | 0.7 | mit | (?:licensed|released|distributed|available) under (?:the )?mit\b
mit | 0.95 | opensource.org | opensource\.org/licenses/mit\b
mit | 0.95 | permission is hereby | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
mit | 0.9 | copyright | the above copyright notice and this permission notice shall be included in all copies
mit | 0.7 | warranty | the software is provided "as is", without warranty of any kind, express or implied
mit-0 | 0.95 | mit | mit no attribution licen[sc]e|mit-0 licen[sc]e
mit-enna | 0.9 | enna | mit licen[sc]e \(enna\)
x11 | 0.95 | x11 | x11 licen[sc]e
x11 | 0.9 | consortium | name of the x consortium shall not be used
bsd-2-clause | 0.95 | bsd | (?:bsd[- ]2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause | 0.95 | bsd | (?:bsd[- ]3[- ]clause|3[- ]clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
bsd-4-clause | 0.95 | bsd | (?:bsd[- ]4[- ]clause|4[- ]clause bsd|original bsd|old bsd)(?: licen[sc]e)?
bsd-0 | 0.95 | bsd | (?:bsd[- ]?0[- ]clause|zero[- ]clause bsd)(?: licen[sc]e)?
bsd | 0.9 | bsd | bsd[- ](?:style )?licen[sc]e
bsd | 0.7 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?bsd\b
bsd-2-clause | 0.95 | opensource.org | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | 0.95 | opensource.org | opensource\.org/licenses/bsd-3-clause
bsd | 0.9 | opensource.org | opensource\.org/licenses/bsd-license
bsd | 0.9 | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd | 0.8 | redistributions | redistributions of source code must retain the above copyright notice
bsd | 0.8 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 0.9 | endorse or promote | may be used to endorse or promote products derived from this software
bsd-4-clause | 0.95 | advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause-clear | 0.95 | clear bsd | clear bsd licen[sc]e
bsd-protection | 0.95 | bsd | bsd protection licen[sc]e
mpl-2.0 | 0.95 | mozilla | mozilla public licen[sc]e,? \(?(?:version|v)\.? ?2(?:\.0)?
mpl-1.1 | 0.95 | mozilla | mozilla public licen[sc]e,? (?:version|v)\.? ?1\.1
mpl-1.0 | 0.95 | mozilla | mozilla public licen[sc]e,? (?:version|v)\.? ?1\.0
mpl | 0.9 | mozilla | mozilla public licen[sc]e
mpl-2.0 | 0.95 | mozilla.org | mozilla\.org/mpl/2\.0
mpl | 0.9 | mozilla.org | mozilla\.org/mpl\b
npl-1.1 | 0.95 | netscape | netscape public licen[sc]e,? (?:version|v)\.? ?1\.1
npl | 0.9 | netscape | netscape public licen[sc]e
epl-2.0 | 0.95 | eclipse | eclipse public licen[sc]e,?(?: -)? ?\(?(?:version|v)?\.? ?2\.0
epl-1.0 | 0.95 | eclipse | eclipse public licen[sc]e,?(?: -)? ?\(?(?:version|v)?\.? ?1\.0
epl | 0.9 | eclipse | eclipse public licen[sc]e
epl | 0.9 | eclipse.org | eclipse\.org/legal/epl
edl-1.0 | 0.95 | eclipse | eclipse distribution licen[sc]e
cpl-1.0 | 0.95 | common public | common public licen[sc]e,?(?: -)? ?(?:version|v)\.? ?1\.0
cpl | 0.9 | common public | common public licen[sc]e
ipl-1.0 | 0.95 | ibm public | ibm public licen[sc]e
cddl-1.1 | 0.95 | common development | common development and distribution licen[sc]e~1\.1
cddl-1.0 | 0.95 | common development | common development and distribution licen[sc]e~1\.0
cddl | 0.9 | common development | common development and distribution licen[sc]e
cddl | 0.8 | cddl | (?:licensed|released|distributed|available) under (?:the )?cddl\b
cpal-1.0 | 0.95 | common public attribution | common public attribution licen[sc]e
eupl-1.2 | 0.95 | european union | european union public licen[sc]e,?~1\.2
eupl-1.1 | 0.95 | european union | european union public licen[sc]e,?~1\.1
eupl | 0.9 | european union | european union public licen[sc]e
cecill-2.1 | 0.95 | cecill | cecill~2\.1
cecill-b | 0.95 | cecill | cecill-b\b
cecill-c | 0.95 | cecill | cecill-c\b
cecill | 0.9 | cecill | cecill (?:free software )?licen[sc]e
isc | 0.95 | isc | \bisc licen[sc]e
isc | 0.9 | permission to use | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
zlib | 0.95 | zlib | zlib(?:/libpng)? licen[sc]e
zlib | 0.9 | misrepresented | the origin of this software must not be misrepresented
libpng | 0.95 | libpng | libpng licen[sc]e
bsl-1.0 | 0.95 | boost | boost software licen[sc]e
bsl-1.0 | 0.95 | boost.org | boost\.org/license_1_0
unlicense | 0.95 | unlicense | \bunlicense\b~public domain|the unlicense\b|unlicense\.org
public-domain | 0.9 | public domain | this is free and unencumbered software released into the public domain
public-domain | 0.8 | public domain | (?:released|placed|dedicated|donated)(?: in)?to the public domain
public-domain | 0.6 | public domain | \bin the public domain
wtfpl | 0.95 | fuck | do what the fuck you want to public licen[sc]e
wtfpl | 0.9 | wtfpl | \bwtfpl\b
beerware | 0.95 | beer | beer-?ware licen[sc]e
cc0-1.0 | 0.95 | cc0 | \bcc0\b(?:[- ]1\.0)?(?: universal)?
cc0-1.0 | 0.95 | publicdomain/zero | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm-1.0 | 0.95 | publicdomain/mark | creativecommons\.org/publicdomain/mark/1\.0
cc-by-4.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by/3\.0
cc-by-2.5 | 0.95 | creativecommons | creativecommons\.org/licenses/by/2\.5
cc-by-2.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by/2\.0
cc-by-sa-4.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-4.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa-3.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nd-4.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-nd-4.0 | 0.95 | creativecommons | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd-4.0 | 0.95 | creative commons | creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s? 4\.0
cc-by-nc-sa-4.0 | 0.95 | creative commons | creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0
cc-by-nc-4.0 | 0.95 | creative commons | creative commons attribution[- ]non-?commercial 4\.0
cc-by-sa-4.0 | 0.95 | creative commons | creative commons attribution[- ]share-?alike 4\.0
cc-by-sa-3.0 | 0.95 | creative commons | creative commons attribution[- ]share-?alike 3\.0
cc-by-4.0 | 0.95 | creative commons | creative commons attribution 4\.0
cc-by-3.0 | 0.95 | creative commons | creative commons attribution 3\.0
cc-by-nc | 0.9 | creative commons | creative commons attribution[- ]non-?commercial
cc-by-sa | 0.9 | creative commons | creative commons attribution[- ]share-?alike
cc-by-nd | 0.9 | creative commons | creative commons attribution[- ]no-?deriv(?:ative)?s?
cc-by | 0.9 | creative commons | creative commons attribution
cc | 0.7 | creative commons | creative commons licen[sc]e
cc-by-sa | 0.85 | cc | \bcc[- ]by[- ]sa\b
cc-by-nc-sa | 0.85 | cc | \bcc[- ]by[- ]nc[- ]sa\b
cc-by-nc-nd | 0.85 | cc | \bcc[- ]by[- ]nc[- ]nd\b
cc-by-nc | 0.85 | cc | \bcc[- ]by[- ]nc\b
cc-by | 0.8 | cc | \bcc[- ]by\b
cc-by-sa | 0.85 | cc-by | \bcc-by-sa\b
cc-by-nc | 0.85 | cc-by | \bcc-by-nc\b
cc-by | 0.8 | cc-by | \bcc-by\b
artistic-2.0 | 0.95 | artistic | artistic licen[sc]e,? (?:version|v)?\.? ?2\.0
artistic-1.0 | 0.95 | artistic | artistic licen[sc]e,? (?:version|v)?\.? ?1\.0
artistic | 0.9 | artistic | artistic licen[sc]e
perl | 0.9 | perl | same terms as perl itself
ruby | 0.9 | ruby | \bruby licen[sc]e|same terms as ruby
python-2.0 | 0.95 | python | python licen[sc]e 2\.0
psf-2.0 | 0.95 | python software | python software foundation licen[sc]e
php-3.01 | 0.95 | php | php licen[sc]e,? version 3\.01
php | 0.9 | php | \bphp licen[sc]e
postgresql | 0.95 | postgresql | postgresql licen[sc]e
openssl | 0.95 | openssl | openssl licen[sc]e
openssl | 0.9 | openssl | this product includes software developed by the openssl project
sleepycat | 0.95 | sleepycat | sleepycat licen[sc]e
ofl-1.1 | 0.95 | open font | (?:sil )?open font licen[sc]e,?~1\.1
ofl | 0.9 | open font | (?:sil )?open font licen[sc]e
ms-pl | 0.95 | microsoft | microsoft public licen[sc]e
ms-rl | 0.95 | microsoft | microsoft reciprocal licen[sc]e
ms-eula | 0.7 | microsoft | microsoft software licen[sc]e terms
upl-1.0 | 0.95 | universal permissive | universal permissive licen[sc]e
ncsa | 0.95 | ncsa | (?:university of illinois/)?ncsa open source licen[sc]e
afl-3.0 | 0.95 | academic free | academic free licen[sc]e,?~3\.0
afl | 0.9 | academic free | academic free licen[sc]e
osl-3.0 | 0.95 | open software | open software licen[sc]e,?~3\.0
osl | 0.9 | open software | open software licen[sc]e
ecl-2.0 | 0.95 | educational community | educational community licen[sc]e
sspl-1.0 | 0.95 | server side | server side public licen[sc]e
busl-1.1 | 0.95 | business source | business source licen[sc]e
elastic-2.0 | 0.95 | elastic | elastic licen[sc]e (?:version |v)?2\.0
elastic | 0.9 | elastic | elastic licen[sc]e
commons-clause | 0.95 | commons clause | commons clause(?: licen[sc]e)? condition
polyform | 0.95 | polyform | polyform (?:noncommercial|small business|shield|strict|internal use) licen[sc]e
odbl-1.0 | 0.95 | open database | open database licen[sc]e
odc-by-1.0 | 0.95 | open data commons | open data commons attribution licen[sc]e
pddl-1.0 | 0.95 | public domain dedication | (?:open data commons )?public domain dedication and licen[sc]e
w3c | 0.95 | w3c | w3c(?:®)? software (?:notice and )?licen[sc]e
vim | 0.95 | vim | \bvim licen[sc]e
zpl-2.1 | 0.95 | zope | zope public licen[sc]e~2\.1
zpl | 0.9 | zope | zope public licen[sc]e
qpl-1.0 | 0.95 | public | \bq public licen[sc]e
sgi-b-2.0 | 0.95 | sgi | sgi free software licen[sc]e b
imagemagick | 0.95 | imagemagick | imagemagick licen[sc]e
ijg | 0.95 | independent jpeg | independent jpeg group
ftl | 0.95 | freetype | freetype (?:project )?licen[sc]e
curl | 0.95 | curl | \bcurl licen[sc]e
tcl | 0.9 | tcl | tcl/tk licen[sc]e
json | 0.95 | good, not evil | the software shall be used for good, not evil
hpnd | 0.9 | historical permission | historical permission notice and disclaimer
lppl-1.3c | 0.95 | latex project | latex project public licen[sc]e~1\.3c
lppl | 0.9 | latex project | latex project public licen[sc]e
mulanpsl-2.0 | 0.95 | mulan | mulan psl v2|mulan permissive software licen[sc]e,? version 2
openrail | 0.9 | openrail | \bopenrail(?:\+\+)?(?:-m)?\b
llama | 0.9 | llama | llama ?[0-9.]* community licen[sc]e
bigscience-rail | 0.95 | bigscience | bigscience rail licen[sc]e
oracle-bcl | 0.9 | binary code | binary code licen[sc]e agreement
proprietary | 0.6 | proprietary | proprietary and confidential
proprietary | 0.5 | reserved | all rights reserved
proprietary | 0.6 | agreement | end[- ]user licen[sc]e agreement
proprietary | 0.6 | redistribute | you may not (?:copy, )?(?:modify, )?(?:or )?redistribute
"""


class Rule:
    """One signature: its place in the order, label, strength, keyword and compiled regex."""

    def __init__(self, order: int, line: str):
        self.order = order
        label, strength, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        self.label, self.strength, self.keyword = label, float(strength), keyword
        self.regex = re.compile(re.sub(r"\[[^\]]*\]|\\.| \?|[ ~]", lambda m: _SHORT.get(m[0], m[0]), pattern))


#: What the short forms of a rule's regex stand for; character classes and escapes stay.
_SHORT = {" ?": r"\s?", " ": r"[\s*#/;,-]{1,20}", "~": r"[^\n]{0,60}?"}


_KEPT = Kept()


def rules() -> list[Rule]:
    return _KEPT.once("rules", lambda: [Rule(i, line) for i, line in enumerate(RULES.strip().splitlines())])


def keywords():
    """One automaton over the words of all keywords; a rule runs where the longest word of its keyword occurs."""
    return _KEPT.once("keywords", _automaton)


def _automaton():
    import ahocorasick

    gates: dict[str, list[int]] = {}
    for r in rules():
        gates.setdefault(max(r.keyword.split(), key=len), []).append(r.order)
    out = ahocorasick.Automaton()
    for word, orders in gates.items():
        out.add_word(word, (word, orders))
    out.make_automaton()
    return out


def candidates(text: str, gated: bool = True) -> list[tuple[int, int, Rule]]:
    """All detections of a lower-cased text by the rules whose keyword occurs; not gated, by all rules."""
    active = sorted({order for _, (_, orders) in keywords().iter(text) for order in orders}) if gated else range(len(rules()))
    return [(m.start(), m.end(), rules()[order]) for order in active for m in rules()[order].regex.finditer(text)]


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """Detections of a lower-cased text that no other one suppresses, by start. They are taken by priority: the stronger,
    then the longer, then the earlier rule, then the earlier place; one that a taken one holds or overlaps is left out."""
    starts: list[int] = []
    taken: list[tuple[int, int, Rule]] = []
    for found in sorted(candidates(text), key=lambda d: (-d[2].strength, d[0] - d[1], d[2].order, d[0])):
        at = bisect_right(starts, found[0])
        if at and taken[at - 1][1] > found[0] or at < len(taken) and starts[at] < found[1]:
            continue
        starts.insert(at, found[0])
        taken.insert(at, found)
    return taken


def n_words(data: bytes) -> int:
    """Number of words of a UTF-8 text: every byte of a character beyond ASCII belongs to a word."""
    kind = _WORD_BYTE[np.frombuffer(data, np.uint8)]
    return int(kind[0]) + int((kind[1:] > kind[:-1]).sum()) if len(kind) else 0


_WORD_BYTE = np.array([1 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.int8)


def base_places(text: str) -> list[tuple[int, str]]:
    """(first word, label) of each place of a base phrase in a lower-cased text."""
    words = _WORD.findall(text)
    out = []
    for phrase, label in BASE.items():
        wanted = phrase.split()
        out += [(i, label) for i, w in enumerate(words) if w == wanted[0] and words[i : i + len(wanted)] == wanted]
    return sorted(out)


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    if not text:
        return 0, 0, None, None, "", "", 0.0, ""
    data = text.encode("utf-8", "replace").lower()  # bytes: only A-Z change
    words, low = n_words(data), data.decode()
    found = detections(low)
    base = base_places(low) if "license" in low else []
    own = {label for _, label in base}
    labels = own | {r.label for _, _, r in found}
    score = max([1.0 * bool(own), *(r.strength for _, _, r in found)])
    places = [i for i, _ in base]
    spans = ",".join(f"{r.label}:{a}:{b}" for a, b, r in found)
    return words, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(labels)), score, spans


_FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_batches(batches):
        columns = list(zip(*map(scan, texts))) or [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS))], names=["doc_id", *(n for n, _ in _FIELDS)])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the method's
    detections as label:start:end over the code points of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    )


ship(__name__)
