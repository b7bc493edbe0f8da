"""The default tables of the licence scan: known sentences, trigger words and ordered rules."""

from __future__ import annotations

# Normalised sentence patterns and their identifiers, most specific first.
SENTENCES: tuple[tuple[str, str], ...] = (
    (r"(?:this \w+ is )?licensed under the apache license,? version (?P<v>\d(?:\.\d)?)(?: \(the [\"“”']*license[\"“”']*\))?", "ApacheVer:{v}"),
    (r"you may not use this file except in compliance with the license", "ApacheCompliance"),
    (r"you may obtain a copy of the license at .*apache\.org/licenses/license-2\.0.*", "ApacheURL"),
    (r"(?:this \w+ is )?(?:released|licensed|distributed) under the (?:terms of the )?mit license", "MITName"),
    (r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.*", "MITPermission"),
    (r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software", "MITNotice"),
    (r"the software is provided \"?as is\"?, without warranty of any kind.*", "AsIsWarranty"),
    (r"(?:this \w+ is )?(?:free software[;:,]? )?(?:released|licensed|distributed) under the (?:terms of the )?gnu (?P<k>lesser |affero )?general public license,?(?: as published by the free software foundation,?)?(?: (?:either )?(?:version|v) ?(?P<v>\d(?:\.\d)?)(?: of the license)?)?(?P<p>,? or \(?at your option\)? any later version)?", "GPLVer:{k}:{v}:{p}"),
    (r"(?:(?:this|the) \w+ is |[\w-]+ is )?free software[;:,]? you can redistribute it and/or modify it under the terms of the gnu (?P<k>lesser |library |affero )?general public license,? as published by the free software foundation[;,]? (?:either )?version (?P<v>\d(?:\.\d)?)(?: of the license)?(?P<p>,? or \(?at your option\)? any later version)?", "GPLVer:{k}:{v}:{p}"),
    (r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met:?", "BSDPermission"),
    (r"redistributions of source code must retain the above copyright notice.*", "BSDSource"),
    (r"redistributions in binary form must reproduce the above copyright notice.*", "BSDBinary"),
    (r"neither the name of .* nor the names of its contributors may be used to endorse or promote products.*", "BSDEndorse"),
    (r"(?:this \w+ is )?(?:released|licensed|distributed) under (?:the )?(?:cc|creative commons)[ -](?P<k>by(?:-(?:nc|sa|nd))*|0)(?: (?:license )?(?:version )?(?P<v>\d\.\d))?", "CCName:{k}:{v}"),
    (r"this source code form is subject to the terms of the mozilla public license,? v\. 2\.0", "MPLName"),
    (r"(?:this \w+ is )?(?:released|licensed|distributed) under the (?P<n>[23])-clause bsd license", "BSDName:{n}"),
    (r"this \w+ is (?:dedicated to|in) the public domain", "PublicDomain"),
    (r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "ISCPermission"),
    (r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "ZeroBSDPermission"),
    (r"the software is provided [\"'“”]?as is[\"'“”]? and the author disclaims all warranties.*", "AuthorDisclaims"),
    (r"this software is provided [\"'“”]?as-is[\"'“”]?, without any express or implied warranty", "ZlibAsIs"),
    (r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.*", "ZlibPermission"),
    (r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*", "BoostPermission"),
    (r"(?:this \w+ is )?(?:released|licensed|distributed) under the boost software license,? version 1\.0.*", "BoostName"),
    (r"boost software license - version 1\.0.*", "BoostName"),
    (r"this is free and unencumbered software released into the public domain", "UnlicenseHead"),
    (r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.*", "UnlicenseFree"),
    (r"do what the fuck you want to public license.*", "WTFPLName"),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public license,? (?:version|v) ?(?P<v>[12]\.0).*", "EPLVer:{v}"),
    (r"the contents of this file are subject to the terms of the common development and distribution license.*", "CDDLTerms"),
    (r"the contents of this file are subject to the mozilla public license,? version (?P<v>1\.[01]).*", "MPLVer:{v}"),
    (r"(?:this \w+ is )?(?:released|licensed|distributed) under the (?:terms of the )?artistic license(?:,? (?:version )?(?P<v>2\.0))?", "ArtisticName:{v}"),
    (r".*under the same terms as perl itself", "PerlTerms"),
    (r"(?:this \w+ is )?(?:released|licensed|distributed) under the (?:terms of the )?python software foundation license.*", "PSFName"),
    (r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.*", "PostgresPermission"),
    (r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted, provided that the above copyright notice appears? in all copies.*", "HPNDPermission"),
    (r"(?:the )?university of illinois/ncsa open source license", "NCSAName"),
    (r"the software shall be used for good, not evil", "JSONGood"),
    (r"this font software is licensed under the sil open font license, version 1\.1.*", "OFLName"),
    (r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license, version (?P<v>\d\.\d)(?P<p> or any later version)?.*", "GFDLVer:{v}:{p}"),
    (r"(?:this \w+|[\w -]+)? ?is (?:made available|licensed) under (?:the|a) creative commons attribution(?P<k>(?:-(?:noncommercial|sharealike|noderivatives|noderivs))*) (?P<v>\d\.\d)(?: (?:international|unported|generic))?(?: (?:public )?license)?", "CCFull:{k}:{v}"),
    (r"to the extent possible under law,? .* (?:has|have) waived all copyright and related or neighboring rights.*", "CC0Waiver"),
    (r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*", "BSDAdvert"),
    (r"use of this source code is governed by (?P<k>a bsd|an mit)-style license that can be found in the license file.*", "StyleOf:{k}"),
    (r"except as contained in this notice, the name(?:\(?s\)?)? of .* shall not be used in advertising.*", "NoAdvertising"),
    (r"this program is distributed in the hope that it will be useful,? but without any warranty.*", "GPLHope"),
    (r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with .*", "GPLCopy"),
    (r"(?:the )?mit license(?: \(mit\))?", "MITTitle"),
    (r"apache license", "ApacheTitle"),
    (r"version 2\.0, january 2004", "ApacheTitleDate"),
    (r"microsoft public license(?: \(ms-pl\))?", "MsPLName"),
    (r"licensed under the eupl,? version (?P<v>1\.[0-2]).*", "EUPLVer:{v}"),
    (r".*software developed by the openssl project for use in the openssl toolkit.*", "OpenSSLAck"),
    (r"\"?the beer-ware license\"?.*", "BeerwareName"),
    (r"business source license 1\.1", "BUSLName"),
    (r"(?:licensed under the )?server side public license,? (?:version|v) ?1.*", "SSPLName"),
    (r"(?:licensed under the )?elastic license(?: version)? 2\.0.*", "ElasticName"),
    (r"this software is provided by the (?:copyright holders and contributors|regents and contributors|author) [\"'“”]?as is[\"'“”]?.*", "BSDWarranty"),
    (r"all rights reserved", "AllRights"),
    (r"(?:copyright )?(?:\(c\)|©|copyright) .*?all rights reserved", "AllRights"),
    (r"spdx-license-identifier: (?P<s>[\w.+-]+)", "SPDX:{s}"),
)
# Words of which every known sentence has one; others cannot map to an identifier.
TRIGGERS = ("licen", "permission", "copyright", "warranty", "redistribution", "neither the name", "public domain", "rights reserved", "(c)", "©", "spdx", "free software", "cc by", "cc-by", "cc 0", "cc-0", "creative commons", "not evil", "advertising", "perl itself", "openssl toolkit", "anyone is free to copy", "provided by the", "january 2004", "disclaims all warranties", "express or implied")
# Ordered rules, a sequence of identifier patterns and the licence that it names.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("ApacheVer:(.+)", "ApacheCompliance", "ApacheURL"), "Apache-{1}"),
    (("ApacheVer:(.+)",), "Apache-{1}"),
    (("ApacheTitle", "ApacheTitleDate"), "Apache-2.0"),
    (("MITPermission", "MITNotice", "JSONGood", "AsIsWarranty"), "JSON"),
    (("MITPermission", "MITNotice", "JSONGood"), "JSON"),
    (("MITPermission", "MITNotice", "AsIsWarranty", "NoAdvertising"), "X11"),
    (("MITPermission", "MITNotice", "AsIsWarranty"), "MIT"),
    (("MITPermission", "MITNotice"), "MIT"),
    (("MITName",), "MIT"),
    (("MITTitle",), "MIT"),
    (("StyleOf:an mit",), "MIT"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDAdvert", "BSDEndorse", "BSDWarranty"), "BSD-4-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDAdvert", "BSDEndorse"), "BSD-4-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty"), "BSD-3-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDEndorse"), "BSD-3-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary", "BSDWarranty"), "BSD-2-Clause"),
    (("BSDPermission", "BSDSource", "BSDBinary"), "BSD-2-Clause"),
    (("BSDName:(.)",), "BSD-{1}-Clause"),
    (("GPLVer::(.+):",), "GPL-{1}-only"),
    (("GPLVer::(.+):.+",), "GPL-{1}-or-later"),
    (("GPLVer:lesser :(.+):",), "LGPL-{1}-only"),
    (("GPLVer:lesser :(.+):.+",), "LGPL-{1}-or-later"),
    (("GPLVer:library :(.+):",), "LGPL-{1}-only"),
    (("GPLVer:library :(.+):.+",), "LGPL-{1}-or-later"),
    (("GPLVer:affero :(.+):",), "AGPL-{1}-only"),
    (("GPLVer:affero :(.+):.+",), "AGPL-{1}-or-later"),
    (("GPLVer:.*",), "GPL"),
    (("CCName:0:(.*)",), "CC0-1.0"),
    (("CCName:(.+):(.+)",), "CC-{1}-{2}"),
    (("CCName:(.+):",), "CC-{1}"),
    (("GPLHope",), ""),
    (("GPLCopy",), ""),
    (("StyleOf:a bsd",), "BSD-3-Clause"),
    (("ISCPermission", "AuthorDisclaims"), "ISC"),
    (("ISCPermission",), "ISC"),
    (("ZeroBSDPermission", "AuthorDisclaims"), "0BSD"),
    (("ZeroBSDPermission",), "0BSD"),
    (("ZlibAsIs", "ZlibPermission"), "Zlib"),
    (("ZlibPermission",), "Zlib"),
    (("BoostName", "BoostPermission"), "BSL-1.0"),
    (("BoostName",), "BSL-1.0"),
    (("BoostPermission",), "BSL-1.0"),
    (("UnlicenseHead", "UnlicenseFree"), "Unlicense"),
    (("UnlicenseHead",), "Unlicense"),
    (("WTFPLName",), "WTFPL"),
    (("EPLVer:(.+)",), "EPL-{1}"),
    (("CDDLTerms",), "CDDL-1.0"),
    (("MPLVer:(.+)",), "MPL-{1}"),
    (("ArtisticName:(.+)",), "Artistic-{1}"),
    (("ArtisticName:",), "Artistic-1.0"),
    (("PerlTerms",), "Artistic-1.0-Perl OR GPL-1.0-or-later"),
    (("PSFName",), "PSF-2.0"),
    (("PostgresPermission",), "PostgreSQL"),
    (("HPNDPermission",), "HPND"),
    (("NCSAName",), "NCSA"),
    (("OFLName",), "OFL-1.1"),
    (("GFDLVer:(.+):",), "GFDL-{1}-only"),
    (("GFDLVer:(.+):.+",), "GFDL-{1}-or-later"),
    (("CCFull::(.+)",), "CC-BY-{1}"),
    (("CCFull:-noncommercial:(.+)",), "CC-BY-NC-{1}"),
    (("CCFull:-sharealike:(.+)",), "CC-BY-SA-{1}"),
    (("CCFull:-noderiv(?:ative)?s:(.+)",), "CC-BY-ND-{1}"),
    (("CCFull:-noncommercial-sharealike:(.+)",), "CC-BY-NC-SA-{1}"),
    (("CCFull:-noncommercial-noderiv(?:ative)?s:(.+)",), "CC-BY-NC-ND-{1}"),
    (("CC0Waiver",), "CC0-1.0"),
    (("MsPLName",), "MS-PL"),
    (("EUPLVer:(.+)",), "EUPL-{1}"),
    (("OpenSSLAck",), "OpenSSL"),
    (("BeerwareName",), "Beerware"),
    (("BUSLName",), "BUSL-1.1"),
    (("SSPLName",), "SSPL-1.0"),
    (("ElasticName",), "Elastic-2.0"),
    (("BSDWarranty",), ""),
    (("MPLName",), "MPL-2.0"),
    (("SPDX:(.+)",), "{1}"),
    (("PublicDomain",), "public-domain"),
    (("AllRights",), "proprietary"),
)
