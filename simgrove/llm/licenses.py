"""License scans (operator 9): ordered signature rules behind a keyword prefilter.

A rule has a label, a priority, a keyword that must stand in the text, and a regular expression over the text with A-Z
lower-cased, in which a name or notice may be wrapped over lines and stand behind comment marks. All detections of a document are resolved together: taken in order
of priority, then length, a detection goes when its interval lies inside one already taken.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .token_counts import byte_slices

# Fixed values of the contract: phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: One rule a line: label, priority, weight, keyword, expression. A blank stands for white space and comment marks.
RULES = r"""
gpl 92 1.0 gpl spdx-license-identifier: [^\n]*?\bgpl\b
lgpl 92 1.0 lgpl spdx-license-identifier: [^\n]*?\blgpl\b
agpl 92 1.0 agpl spdx-license-identifier: [^\n]*?\bagpl\b
apache 92 1.0 apache spdx-license-identifier: [^\n]*?\bapache\b
mpl 92 1.0 mpl spdx-license-identifier: [^\n]*?\bmpl\b
epl 92 1.0 epl spdx-license-identifier: [^\n]*?\bepl\b
gpl-2.0 90 1.0 gpl-2.0 spdx-license-identifier: [^\n]*?\bgpl-2\.0(?:-only|-or-later|\+)?\b
gpl-3.0 90 1.0 gpl-3.0 spdx-license-identifier: [^\n]*?\bgpl-3\.0(?:-only|-or-later|\+)?\b
gpl-1.0 90 1.0 gpl-1.0 spdx-license-identifier: [^\n]*?\bgpl-1\.0(?:-only|-or-later|\+)?\b
lgpl-2.0 90 1.0 lgpl-2.0 spdx-license-identifier: [^\n]*?\blgpl-2\.0(?:-only|-or-later|\+)?\b
lgpl-2.1 90 1.0 lgpl-2.1 spdx-license-identifier: [^\n]*?\blgpl-2\.1(?:-only|-or-later|\+)?\b
lgpl-3.0 90 1.0 lgpl-3.0 spdx-license-identifier: [^\n]*?\blgpl-3\.0(?:-only|-or-later|\+)?\b
agpl-3.0 90 1.0 agpl-3.0 spdx-license-identifier: [^\n]*?\bagpl-3\.0(?:-only|-or-later|\+)?\b
apache-2.0 90 1.0 apache-2.0 spdx-license-identifier: [^\n]*?\bapache-2\.0\b
apache-1.1 90 1.0 apache-1.1 spdx-license-identifier: [^\n]*?\bapache-1\.1\b
mit 90 1.0 mit spdx-license-identifier: [^\n]*?\bmit\b(?!-)
mit-0 90 1.0 mit-0 spdx-license-identifier: [^\n]*?\bmit-0\b
bsd-2-clause 90 1.0 bsd-2-clause spdx-license-identifier: [^\n]*?\bbsd-2-clause\b
bsd-3-clause 90 1.0 bsd-3-clause spdx-license-identifier: [^\n]*?\bbsd-3-clause\b
bsd-4-clause 90 1.0 bsd-4-clause spdx-license-identifier: [^\n]*?\bbsd-4-clause\b
0bsd 90 1.0 0bsd spdx-license-identifier: [^\n]*?\b0bsd\b
isc 90 1.0 isc spdx-license-identifier: [^\n]*?\bisc\b
mpl-2.0 90 1.0 mpl-2.0 spdx-license-identifier: [^\n]*?\bmpl-2\.0\b
mpl-1.1 90 1.0 mpl-1.1 spdx-license-identifier: [^\n]*?\bmpl-1\.1\b
epl-2.0 90 1.0 epl-2.0 spdx-license-identifier: [^\n]*?\bepl-2\.0\b
epl-1.0 90 1.0 epl-1.0 spdx-license-identifier: [^\n]*?\bepl-1\.0\b
cddl-1.0 90 1.0 cddl-1.0 spdx-license-identifier: [^\n]*?\bcddl-1\.0\b
eupl-1.2 90 1.0 eupl-1.2 spdx-license-identifier: [^\n]*?\beupl-1\.2\b
bsl-1.0 90 1.0 bsl-1.0 spdx-license-identifier: [^\n]*?\bbsl-1\.0\b
busl-1.1 90 1.0 busl-1.1 spdx-license-identifier: [^\n]*?\bbusl-1\.1\b
zlib 90 1.0 zlib spdx-license-identifier: [^\n]*?\bzlib\b
unlicense 90 1.0 unlicense spdx-license-identifier: [^\n]*?\bunlicense\b
wtfpl 90 1.0 wtfpl spdx-license-identifier: [^\n]*?\bwtfpl\b
cc0 90 1.0 cc0-1.0 spdx-license-identifier: [^\n]*?\bcc0-1\.0\b
cc-by-4.0 90 1.0 cc-by-4.0 spdx-license-identifier: [^\n]*?\bcc-by-4\.0\b
cc-by-sa-4.0 90 1.0 cc-by-sa-4.0 spdx-license-identifier: [^\n]*?\bcc-by-sa-4\.0\b
ofl-1.1 90 1.0 ofl-1.1 spdx-license-identifier: [^\n]*?\bofl-1\.1\b
artistic-2.0 90 1.0 artistic-2.0 spdx-license-identifier: [^\n]*?\bartistic-2\.0\b
ncsa 90 1.0 ncsa spdx-license-identifier: [^\n]*?\bncsa\b
postgresql 90 1.0 postgresql spdx-license-identifier: [^\n]*?\bpostgresql\b
sspl-1.0 90 1.0 sspl-1.0 spdx-license-identifier: [^\n]*?\bsspl-1\.0\b
spdx 20 0.5 spdx spdx-license-identifier: [a-z0-9]
cc-by 85 1.0 creativecommons creativecommons\.org/licenses/by/\d
cc-by-sa 85 1.0 creativecommons creativecommons\.org/licenses/by-sa/\d
cc-by-nd 85 1.0 creativecommons creativecommons\.org/licenses/by-nd/\d
cc-by-nc 85 1.0 creativecommons creativecommons\.org/licenses/by-nc/\d
cc-by-nc-sa 85 1.0 creativecommons creativecommons\.org/licenses/by-nc-sa/\d
cc-by-nc-nd 85 1.0 creativecommons creativecommons\.org/licenses/by-nc-nd/\d
cc0 85 1.0 creativecommons creativecommons\.org/publicdomain/zero/1\.0
public-domain 85 1.0 creativecommons creativecommons\.org/publicdomain/mark/1\.0
apache-2.0 85 1.0 apache apache\.org/licenses/license-2\.0
apache-1.1 85 1.0 apache apache\.org/licenses/license-1\.1
gpl-2.0 85 1.0 gnu gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 85 1.0 gnu gnu\.org/licenses/gpl-3\.0
gpl 82 0.9 gnu gnu\.org/(?:copyleft|licenses)/gpl(?:\.html|\.txt|/)
lgpl-2.1 85 1.0 gnu gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 85 1.0 gnu gnu\.org/licenses/lgpl-3\.0
agpl-3.0 85 1.0 gnu gnu\.org/licenses/agpl-3\.0
gfdl-1.3 85 1.0 gnu gnu\.org/licenses/fdl-1\.3
mit 85 0.95 opensource opensource\.org/licenses?/mit\b
bsd-3-clause 85 0.95 opensource opensource\.org/licenses?/bsd-3-clause
bsd-2-clause 85 0.95 opensource opensource\.org/licenses?/bsd-2-clause
isc 85 0.95 opensource opensource\.org/licenses?/isc\b
osl-3.0 85 0.95 opensource opensource\.org/licenses?/osl-3\.0
afl-3.0 85 0.95 opensource opensource\.org/licenses?/afl-3\.0
mpl-2.0 85 1.0 mozilla mozilla\.org/mpl/2\.0
mpl-1.1 85 1.0 mozilla mozilla\.org/mpl/mpl-1\.1
epl-1.0 85 1.0 eclipse eclipse\.org/legal/epl-v10
epl-2.0 85 1.0 eclipse eclipse\.org/legal/epl-(?:v20|2\.0)
bsl-1.0 85 1.0 boost boost\.org/license_1_0
unlicense 85 1.0 unlicense unlicense\.org/?
wtfpl 85 1.0 wtfpl (?:sam\.zoy\.org/wtfpl|wtfpl\.net)
ofl-1.1 85 1.0 sil scripts\.sil\.org/ofl
php 85 0.9 php php\.net/license/3_0
odbl-1.0 85 0.95 opendatacommons opendatacommons\.org/licenses/odbl
odc-by-1.0 85 0.95 opendatacommons opendatacommons\.org/licenses/by
pddl-1.0 85 0.95 opendatacommons opendatacommons\.org/licenses/pddl
gpl-2.0 80 0.95 general gnu general public licen[sc]e,? (?:as published by the free software foundation[;,] )?(?:either )?(?:version|v\.?) ?2(?!\.?\d)
gpl-3.0 80 0.95 general gnu general public licen[sc]e,? (?:as published by the free software foundation[;,] )?(?:either )?(?:version|v\.?) ?3(?!\.?\d)
gpl-1.0 80 0.95 general gnu general public licen[sc]e,? (?:version|v\.?) ?1(?!\.?\d)
lgpl-2.0 80 0.95 library gnu library general public licen[sc]e,? (?:version|v\.?) ?2(?!\.?[1-9])
lgpl-2.1 80 0.95 lesser gnu lesser general public licen[sc]e,? (?:as published by the free software foundation[;,] )?(?:either )?(?:version|v\.?) ?2\.1
lgpl-3.0 80 0.95 lesser gnu lesser general public licen[sc]e,? (?:as published by the free software foundation[;,] )?(?:either )?(?:version|v\.?) ?3
agpl-3.0 80 0.95 affero affero general public licen[sc]e,? (?:version|v\.?) ?3
agpl-1.0 80 0.95 affero affero general public licen[sc]e,? (?:version|v\.?) ?1
gfdl-1.1 80 0.95 documentation gnu free documentation licen[sc]e,? version 1\.1
gfdl-1.2 80 0.95 documentation gnu free documentation licen[sc]e,? version 1\.2
gfdl-1.3 80 0.95 documentation gnu free documentation licen[sc]e,? version 1\.3
apache-2.0 80 0.95 apache apache (?:software )?licen[sc]e,? (?:\(?(?:version|v\.?) ?)?2(?:\.0)?(?!\.?\d)
apache-1.1 80 0.95 apache apache software licen[sc]e,? (?:version|v\.?) ?1\.1
apache-1.0 80 0.95 apache apache (?:group )?licen[sc]e,? (?:version|v\.?) ?1\.0
mpl-1.0 80 0.95 mozilla mozilla public licen[sc]e,? (?:version|v\.?) ?1\.0
mpl-1.1 80 0.95 mozilla mozilla public licen[sc]e,? (?:\(?(?:version|v\.?) ?)?1\.1
mpl-2.0 80 0.95 mozilla mozilla public licen[sc]e,? (?:\(?(?:version|v\.?) ?)?2\.0
epl-1.0 80 0.95 eclipse eclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)?1\.0
epl-2.0 80 0.95 eclipse eclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)?2\.0
cddl-1.0 80 0.95 cddl common development and distribution licen[sc]e,? (?:\(cddl\),? )?(?:version|v) ?1\.0
cddl-1.1 80 0.95 cddl common development and distribution licen[sc]e,? (?:\(cddl\),? )?(?:version|v) ?1\.1
eupl-1.1 80 0.95 european european union public licen[sc]e,? (?:version|v\.?) ?1\.1
eupl-1.2 80 0.95 european european union public licen[sc]e,? (?:version|v\.?) ?1\.2
artistic-1.0 80 0.95 artistic artistic licen[sc]e,? (?:version )?1\.0
artistic-2.0 80 0.95 artistic artistic licen[sc]e,? (?:version )?2\.0
bsl-1.0 80 0.95 boost boost software licen[sc]e,? (?:- )?version 1\.0
busl-1.1 80 0.95 business business source licen[sc]e,? (?:version )?1\.1
osl-3.0 80 0.95 open open software licen[sc]e,? (?:version|v\.?) ?3\.0
afl-2.1 80 0.95 academic academic free licen[sc]e,? version 2\.1
afl-3.0 80 0.95 academic academic free licen[sc]e,? version 3\.0
ofl-1.1 80 0.95 font sil open font licen[sc]e,? version 1\.1
odbl-1.0 80 0.95 database open (?:data commons )?(?:open )?database licen[sc]e,? (?:\(odbl\),? )?(?:v|version )1\.0
sspl-1.0 80 0.95 server server side public licen[sc]e,? (?:version|v) ?1
elastic-2.0 80 0.95 elastic elastic licen[sc]e,? (?:version )?2\.0
cecill-2.1 80 0.95 cecill cecill(?: free software)? licen[sc]e (?:agreement )?,?(?:version )?2\.1
lppl-1.3c 80 0.95 latex latex project public licen[sc]e,? (?:either )?version 1\.3c?
zpl-2.1 80 0.95 zope zope public licen[sc]e,? (?:\(zpl\) )?version 2\.1
mulan-2.0 80 0.95 mulan mulan (?:psl|permissive software licen[sc]e),? ?(?:version|v) ?2
ms-pl 78 0.95 microsoft microsoft public licen[sc]e
ms-rl 78 0.95 microsoft microsoft reciprocal licen[sc]e
ecl-2.0 80 0.95 educational educational community licen[sc]e,? version 2\.0
vsl-1.0 80 0.95 vovida vovida software licen[sc]e,? version 1\.0
w3c 78 0.9 w3c w3c (?:software|document) (?:notice and )?licen[sc]e
cpal-1.0 80 0.95 attribution common public attribution licen[sc]e,? version 1\.0
apsl-2.0 80 0.95 apple apple public source licen[sc]e,? (?:version )?2\.0
npl-1.1 80 0.95 netscape netscape public licen[sc]e,? version 1\.1
sissl 78 0.9 industry sun industry standards source licen[sc]e
rpl-1.5 80 0.95 reciprocal reciprocal public licen[sc]e,? (?:version )?1\.5
openrail 78 0.9 openrail \bopenrail(?:-m|\+\+)?\b
llama 78 0.9 llama llama(?: \d)? community licen[sc]e
polyform 78 0.9 polyform polyform (?:noncommercial|shield|strict|small business|free trial) licen[sc]e
commons-clause 78 0.9 clause \bcommons clause\b (?:licen[sc]e )?condition
mit 70 0.95 hereby permission is hereby granted,? free of charge,? to any person obtaining a copy of this software
mit 68 0.9 hereby permission is hereby granted,? free of charge,? to any person obtaining a copy
mit 66 0.85 copyright the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit 60 0.7 noninfringement warranties of merchantability,? fitness for a particular purpose and noninfringement
mit 40 0.5 provided the software is provided .?as is.?,? without warranty of any kind
bsd 70 0.95 redistribution redistribution and use in source and binary forms
bsd-3-clause 72 0.9 endorse may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause 74 0.9 advertising all advertising materials mentioning features or use of this software must display
bsd 60 0.7 redistributions redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice
bsd 50 0.6 regents the regents of the university of california
isc 70 0.95 permission permission to use,? copy,? modify,? and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted
0bsd 72 0.9 permission permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted\.
hpnd 62 0.8 permission permission to use,? copy,? modify,? and distribute this software and its documentation for any purpose
gpl 66 0.9 redistribute this program is free software[:;,] you can redistribute it and/or modify
gpl 64 0.8 useful this program is distributed in the hope that it will be useful
gpl 62 0.8 received you should have received a copy of the gnu general public licen[sc]e
lgpl 68 0.9 redistribute this library is free software[:;,] you can redistribute it and/or modify
lgpl 66 0.8 useful this library is distributed in the hope that it will be useful
lgpl 64 0.8 received you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e
agpl 64 0.8 received you should have received a copy of the gnu affero general public licen[sc]e
gfdl 68 0.9 invariant with no invariant sections,? (?:with )?no front-cover texts
apache 70 0.95 licensed licensed under the apache licen[sc]e
apache 66 0.85 compliance you may not use this file except in compliance with the licen[sc]e
apache 64 0.85 foundation licensed to the apache software foundation
apache 50 0.6 distributed distributed on an .?as is.? basis,? without warranties or conditions of any kind
mpl 70 0.95 mozilla subject to the terms of the mozilla public licen[sc]e
mpl 66 0.85 contents the contents of this file are subject to the (?:mozilla|netscape) public licen[sc]e
epl 70 0.95 eclipse made available under the terms of the eclipse public licen[sc]e
cddl 70 0.95 development subject to the terms of the common development and distribution licen[sc]e
zlib 70 0.95 implied this software is provided .?as-is.?,? without any express or implied warranty
zlib 68 0.85 misrepresented the origin of this software must not be misrepresented
bsl-1.0 70 0.95 boost distributed under the boost software licen[sc]e
unlicense 70 0.95 unencumbered this is free and unencumbered software released into the public domain
wtfpl 70 0.95 fuck do what the fuck you want to
ofl 70 0.95 font licensed under the sil open font licen[sc]e
ofl 66 0.85 reserved with reserved font name
artistic 66 0.85 perl under the same terms as perl itself
beerware 70 0.9 beer buy me a beer in return
json 70 0.9 evil shall be used for good,? not evil
ncsa 66 0.8 illinois university of illinois/ncsa open source licen[sc]e
openssl 66 0.85 openssl this product includes software developed by the openssl project
psf-2.0 66 0.85 python python software foundation licen[sc]e version 2
postgresql 68 0.9 postgresql postgresql database management system
curl 68 0.85 fee use,? copy,? modify,? and distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright
fsfap 66 0.8 royalty copying and distribution of this file,? with or without modification,? are permitted in any medium without royalty
x11 66 0.8 consortium the x consortium shall not be used in advertising
public-domain 60 0.8 domain (?:released|dedicated|placed) (?:in)?to the public domain
public-domain 55 0.7 domain (?:is|are|work) in the public domain
cc0 70 0.9 cc0 \bcc0(?:[- ]1\.0)?\b
cc0 70 0.9 zero creative commons zero|cc zero licen[sc]e
cc0 65 0.85 waive waive all copyright and related (?:or|and) neighboring rights
cc-by-nc-nd 76 0.85 cc \bcc[- ]by[- ]nc[- ]nd\b
cc-by-nc-sa 76 0.85 cc \bcc[- ]by[- ]nc[- ]sa\b
cc-by-nc 74 0.85 cc \bcc[- ]by[- ]nc\b
cc-by-nd 74 0.85 cc \bcc[- ]by[- ]nd\b
cc-by-sa 74 0.85 cc \bcc[- ]by[- ]sa\b
cc-by 72 0.85 cc \bcc[- ]by\b
cc-by-nc-nd 76 0.85 creative creative commons attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s
cc-by-nc-sa 76 0.85 creative creative commons attribution[- ]non ?commercial[- ]share ?alike
cc-by-nc 74 0.85 creative creative commons attribution[- ]non ?commercial
cc-by-nd 74 0.85 creative creative commons attribution[- ]no ?deriv(?:ative)?s
cc-by-sa 74 0.85 creative creative commons attribution[- ]share ?alike
cc-by 72 0.85 creative creative commons attribution
gpl 60 0.8 general gnu general public licen[sc]e
lgpl 60 0.8 general gnu (?:lesser|library) general public licen[sc]e
agpl 60 0.8 affero (?:gnu )?affero general public licen[sc]e
gfdl 60 0.8 documentation gnu free documentation licen[sc]e
apache 58 0.8 apache apache (?:software )?licen[sc]e
mit 58 0.8 mit \bmit licen[sc]e\b
mit 58 0.8 expat \bexpat licen[sc]e\b
bsd-2-clause 62 0.8 bsd (?:2|two)[- ]clause bsd(?: licen[sc]e)?
bsd-3-clause 62 0.8 bsd (?:3|three)[- ]clause bsd(?: licen[sc]e)?
bsd-4-clause 62 0.8 bsd (?:4|four)[- ]clause bsd(?: licen[sc]e)?
bsd-2-clause 62 0.8 simplified simplified bsd licen[sc]e|freebsd licen[sc]e
bsd-3-clause 62 0.8 bsd (?:new|modified|revised) bsd licen[sc]e
bsd-4-clause 62 0.8 bsd (?:original|old) bsd licen[sc]e
bsd 58 0.8 bsd \bbsd(?:-style)? licen[sc]e
isc 58 0.8 isc \bisc licen[sc]e|internet systems consortium licen[sc]e
mpl 58 0.8 mozilla mozilla public licen[sc]e
epl 58 0.8 eclipse eclipse public licen[sc]e
cddl 58 0.8 distribution common development and distribution licen[sc]e
cpl 58 0.8 common \bcommon public licen[sc]e
ipl 58 0.8 ibm \bibm public licen[sc]e
eupl 58 0.8 european european union public licen[sc]e
artistic 58 0.8 artistic \b(?:clarified |perl )?artistic licen[sc]e
bsl 58 0.8 boost boost software licen[sc]e
busl 58 0.8 business business source licen[sc]e
zlib 58 0.8 zlib \bzlib(?:/libpng)? licen[sc]e
unlicense 58 0.8 unlicense \bthe unlicense\b
wtfpl 58 0.8 wtfpl \bwtfpl\b
psf 58 0.8 python python software foundation licen[sc]e
ofl 58 0.8 font \bopen font licen[sc]e
osl 58 0.8 open \bopen software licen[sc]e
afl 58 0.8 academic academic free licen[sc]e
odbl 58 0.8 database \bopen (?:data commons open )?database licen[sc]e
sspl 58 0.8 server server side public licen[sc]e
elastic 58 0.8 elastic \belastic licen[sc]e
cecill 58 0.8 cecill \bcecill(?:-[abc])?\b
upl 58 0.8 universal universal permissive licen[sc]e
postgresql 58 0.8 postgresql postgresql licen[sc]e
openssl 58 0.8 openssl openssl licen[sc]e
ruby 58 0.8 ruby \bruby(?:'s)? licen[sc]e
php 58 0.8 php \bphp licen[sc]e
vim 58 0.8 vim \bvim licen[sc]e
zpl 58 0.8 zope zope public licen[sc]e
qpl 58 0.8 q \bq public licen[sc]e
lppl 58 0.8 latex latex project public licen[sc]e
mulan 58 0.8 mulan mulan permissive software licen[sc]e
gpl-2.0 56 0.8 gpl \bgpl[- ]?v?2(?:\.0)?\b(?!\.\d)
gpl-3.0 56 0.8 gpl \bgpl[- ]?v?3(?:\.0)?\b(?!\.\d)
lgpl-2.1 56 0.8 lgpl \blgpl[- ]?v?2\.1\b
lgpl-3.0 56 0.8 lgpl \blgpl[- ]?v?3(?:\.0)?\b
agpl-3.0 56 0.8 agpl \bagpl[- ]?v?3(?:\.0)?\b
mpl-2.0 56 0.8 mpl \bmpl[- ]?v?2(?:\.0)?\b
epl-1.0 56 0.8 epl \bepl[- ]?v?1(?:\.0)?\b
epl-2.0 56 0.8 epl \bepl[- ]?v?2(?:\.0)?\b
gpl 45 0.6 gpl (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl\b
mit 45 0.7 mit (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit\b
bsd 45 0.7 bsd (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:a |the )?bsd\b
proprietary 55 0.8 confidential proprietary and confidential|confidential and proprietary
proprietary 52 0.7 unauthorized unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|material|document)
proprietary 50 0.6 rights \ball rights reserved\b
proprietary 50 0.6 permission may not be (?:reproduced|copied|redistributed) without (?:prior )?(?:written )?permission
no-commercial 50 0.6 non for non-?commercial use only
copyright 10 0.3 copyright \bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d\b
copyright 10 0.3 © © ?(?:19|20)\d\d\b
"""


#: What a blank of an expression stands for: white space, and the comment marks of wrapped lines.
GAP = r"[\s*#;/%]+"


def rules() -> list[tuple[str, int, float, str, re.Pattern]]:
    """(label, priority, weight, keyword, expression), highest priority first."""
    found = [line.split(" ", 4) for line in RULES.strip().split("\n")]
    made = []
    for label, priority, weight, keyword, expression in found:
        for written, meant in (("[- ]", f"(?:-|{GAP})"), (" ?", f"(?:{GAP})?"), (" ", GAP)):
            expression = expression.replace(written, meant)
        made.append((label, int(priority), float(weight), keyword, re.compile(expression)))
    return sorted(made, key=lambda r: -r[1])


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.gate = ahocorasick.Automaton()
        for i, (_, _, _, keyword, _) in enumerate(self.rules):
            self.gate.add_word(keyword, (*self.gate.get(keyword, ()), i))
        for phrase, _ in PHRASES:
            self.gate.add_word(phrase.split()[-1], (*self.gate.get(phrase.split()[-1], ()), -1))
        self.gate.make_automaton()
        self.phrases = [(phrase.encode().split(), label) for phrase, label in PHRASES]

    def detect(self, text: str, due: set[int]) -> list[tuple[str, float, int, int]]:
        """(label, weight, start, end) of the detections that stay, in order of the text."""
        hits = [(self.rules[i][1], m.end() - m.start(), m.start(), m.end(), self.rules[i][0], self.rules[i][2]) for i in due if i >= 0 for m in self.rules[i][4].finditer(text)]
        taken: list[tuple[str, float, int, int]] = []
        highest: list[tuple[int, int]] = []  # taken intervals by start, none inside another
        import bisect

        for _, _, a, b, label, weight in sorted(hits, key=lambda h: (-h[0], -h[1], h[2], h[4])):
            at = bisect.bisect_right(highest, (a, float("inf"))) - 1
            if at >= 0 and highest[at][1] >= b:
                continue
            while at + 1 < len(highest) and highest[at + 1][1] <= b:
                highest.pop(at + 1)
            highest.insert(at + 1, (a, b))
            taken.append((label, weight, a, b))
        return sorted(taken, key=lambda t: (t[2], t[3], t[0]))

    def scan(self, raw: bytes) -> tuple:
        """n_base, first_word, last_word, base labels, labels, score of a lower-cased text."""
        text = raw.decode("utf-8", "replace")
        due = {i for _, found in self.gate.iter(text) for i in found}
        if not due:
            return 0, None, None, "", "", 0.0
        n, places, base = 0, [], set()
        if -1 in due:
            words = re.findall(rb"[0-9a-z\x80-\xff]+", raw)
            for phrase, label in self.phrases:
                for i in _places(words, phrase):
                    n += 1
                    places.append(i)
                    base.add(label)
        found = self.detect(text, due)
        miss = 1.0
        for _, weight, _, _ in found:
            miss *= 1 - min(weight, 0.99)
        score = max(1 - miss, 1.0 if base else 0.0)
        return n, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {f[0] for f in found})), score


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    at, out = -1, []
    rarest = len(phrase) - 1
    while True:
        try:
            at = words.index(phrase[rarest], at + 1)
        except ValueError:
            return out
        if at >= rarest and words[at - rarest : at + 1] == phrase:
            out.append(at - rarest)


_scanner: list[Scanner] = []
RESULT = "doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: the places where a phrase's words stand one after the other; their labels always stay. Rules
    add labels. score is 1 with a base phrase, else 1 - product of (1 - weight) of the detections.
    A null or empty text has no words, empty labels and score 0. Repeated rows give a row each, an empty
    table none; other columns are ignored. No shuffle; a text of any length is scanned whole.
    """

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                raw, bounds = K.text_bytes(batch.column("text"))
                raw = K.LOWER[raw]
                starts, _ = K.spans(K.ALNUM[raw], bounds)
                n_words = np.diff(K.per_document(bounds, starts))
                data = raw.tobytes()
                rows = [_scanner[0].scan(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n, first, last, base, labels, score = zip(*rows, strict=True) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT.format(kind=kind))
