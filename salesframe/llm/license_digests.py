"""Long licence texts: (licence, paragraphs, first paragraph, SHA-256 of the whole), in canonical form.

Written by make_license_digests.py.
"""

# Whole texts, and those without what follows their terms.
FULL = [
    ('Apache-2.0', 26, 'apache license version 2 0 january 2004 http www apache org licenses', '824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f'),
    ('Apache-2.0', 27, 'apache license version 2 0 january 2004 http www apache org licenses', '119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40'),
    ('Apache-2.0', 32, 'apache license version 2 0 january 2004 http www apache org licenses', '04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543'),
    ('Artistic-1.0-Perl', 29, 'the artistic license', '08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702'),
    ('BSD-3-Clause', 3, 'copyright the regents of the university of california all rights reserved', '3be7b05d2bc7969196bcb689439f05b2628674c7985ce680e26feea60651529b'),
    ('CC0-1.0', 13, 'creative commons legal code', '96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f'),
    ('GFDL-1.2', 57, 'gnu free documentation license version 1 2 november 2002', '187a96a494029ebd41e70c03b8a3e0436d5d34cdd042a4e3ca190290334b7646'),
    ('GFDL-1.3', 67, 'gnu free documentation license version 1 3 3 november 2008', 'c68410bc365648dcf4dd77ba88bcf1eaa1b6e6bf015d834c150d2221696943d4'),
    ('GPL-1.0', 34, 'gnu general public license version 1 february 1989', '89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70'),
    ('GPL-1.0', 35, 'gnu general public license version 1 february 1989', '6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc'),
    ('GPL-1.0', 50, 'gnu general public license version 1 february 1989', 'd9b8ba84cf446891218ba79f7f4dd80d65e69f510cce91a53bee0a87f760b5d9'),
    ('GPL-2.0', 43, 'gnu general public license version 2 june 1991', '6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808'),
    ('GPL-2.0', 44, 'gnu general public license version 2 june 1991', 'e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34'),
    ('GPL-2.0', 59, 'gnu general public license version 2 june 1991', 'fca9d0597eee5ef85465916ba61b41fd1ec4ba0a53efd599baa65c1a5b426a9b'),
    ('GPL-3.0', 108, 'gnu general public license version 3 29 june 2007', '092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191'),
    ('GPL-3.0', 109, 'gnu general public license version 3 29 june 2007', 'ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636'),
    ('GPL-3.0', 122, 'gnu general public license version 3 29 june 2007', 'ae4b99738073ffde61412ab13252e0ed47e0d29b0cd510ed5c8d9a494f7c159d'),
    ('LGPL-2.0', 70, 'gnu library general public license version 2 june 1991', '430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2'),
    ('LGPL-2.0', 71, 'gnu library general public license version 2 june 1991', '504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260'),
    ('LGPL-2.0', 83, 'gnu library general public license version 2 june 1991', '61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908'),
    ('LGPL-2.1', 72, 'gnu lesser general public license version 2 1 february 1999', 'bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df'),
    ('LGPL-2.1', 73, 'gnu lesser general public license version 2 1 february 1999', '48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4'),
    ('LGPL-2.1', 85, 'gnu lesser general public license version 2 1 february 1999', '4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891'),
    ('LGPL-3.0', 37, 'gnu lesser general public license version 3 29 june 2007', 'aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be'),
    ('MPL-1.1', 73, 'mozilla public license version 1 1', '7d12f855545d8e299266bf347b4595de5f0166c462147a20d1de58f75a534328'),
    ('MPL-2.0', 83, 'mozilla public license version 2 0', '12274540925f246f7614a52b7ebddfbe0463ff1ab194088c554c73552c45582d'),
]
