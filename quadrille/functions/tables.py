"""Tables that enrichment reads. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

#: Labels of media types.
MEDIA_LABELS = [
    ("video/mp4", "Video (MP4)"), ("video/mpeg", "Video (MPEG)"), ("video/quicktime", "Video (QuickTime)"), ("video/webm", "Video (WebM)"), ("video/x-m4v", "Video (M4V)"),
    ("video/x-ms-wmv", "Video (WMV)"), ("video/x-msvideo", "Video (AVI)"), ("video/x-matroska", "Video (MKV)"), ("video/3gpp", "Video (3GP)"), ("video/x-flv", "Video (FLV)"),
    ("audio/aac", "Audio (AAC)"), ("audio/mp4", "Audio (MP4)"), ("audio/mpeg", "Audio (MP3)"), ("audio/ogg", "Audio (OGG)"), ("audio/x-matroska", "Audio (MKA)"),
    ("audio/x-pn-realaudio", "Audio (RealAudio)"), ("audio/x-wav", "Audio (WAV)"), ("audio/wav", "Audio (WAV)"), ("audio/flac", "Audio (FLAC)"), ("audio/webm", "Audio (WebM)"),
    ("audio/x-ms-wma", "Audio (WMA)"), ("audio/x-aiff", "Audio (AIFF)"),
    ("image/bmp", "Image (BMP)"), ("image/gif", "Image (GIF)"), ("image/jpeg", "Image (JPEG)"), ("image/pcx", "Image (PCX)"), ("image/pict", "Image (PICT)"),
    ("image/png", "Image (PNG)"), ("image/svg+xml", "Vectiorial Image (SVG)"), ("image/tiff", "Image (TIFF)"), ("image/vnd.djvu", "Image (DjVu)"), ("image/vnd.fpx", "Image (FlashPix)"),
    ("image/webp", "Image (WebP)"), ("image/x-cursor", "Image (Cursor)"), ("image/x-icon", "Image (Icon)"), ("image/x-jps", "Image (JPS)"), ("image/heic", "Image (HEIC)"), ("image/heif", "Image (HEIF)"),
    ("application/msword", "Document (Word Legacy)"), ("application/vnd.ms-word.template.macroEnabledTemplate", "Template (Word with Macro)"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "Document (Word)"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.template", "Template (Word)"),
    ("application/vnd.oasis.opendocument.text", "Document (OpenDocument)"), ("application/pdf", "Document (PDF)"), ("text/html", "Document Web (HTML)"), ("text/plain", "Document (Text)"), ("text/rtf", "Document (RTF)"),
    ("application/vnd.ms-excel", "Spreadsheet (Excel Legacy)"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "Spreadsheet (Excel)"), ("application/vnd.oasis.opendocument.spreadsheet", "Spreadsheet (OpenDocument)"),
    ("application/vnd.ms-powerpoint", "Presentation (PowerPoint Legacy)"), ("application/vnd.ms-officetheme", "Theme (Office)"), ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "Presentation (PowerPoint)"), ("application/vnd.oasis.opendocument.presentation", "Presentation (OpenDocument)"),
    ("application/epub+zip", "E-Book (EPUB)"), ("application/x-mobipocket-ebook", "E-Book (Mobipocket)"),
    ("application/zip", "Archive (ZIP)"), ("application/x-7z-compressed", "Archive (7Z)"), ("application/x-rar-compressed", "Archive (RAR)"), ("application/bzip2", "Archive (BZip2)"), ("application/x-gzip", "Archive (GZip)"), ("application/gzip", "Archive (GZip)"), ("application/x-tar", "Archive (TAR)"),
    ("font/woff", "Font (WOFF)"), ("font/woff2", "Font (WOFF2)"), ("application/x-font-ttf", "Font (TrueType)"), ("application/font-woff", "Font (WOFF)"), ("application/font-woff2", "Font (WOFF2)"),
    ("application/json", "Data (JSON)"), ("application/xml", "Data (XML)"), ("application/rdf+xml", "Semantic data (RDF)"), ("text/xml", "Data (XML)"), ("text/csv", "Table (CSV)"), ("application/vnd.iccprofile", "Color Profile (ICC)"),
    ("application/x-iso9660-image", "Disk Image (ISO)"), ("application/x-shockwave-flash", "Application (Flash)"), ("application/vnd.adobe.air-application-installer-package+zip", "Application (Adobe AIR)"), ("application/x-msdownload", "Application (Windows)"), ("application/x-executable", "Application (Eseguibile)"),
    ("application/x-bittorrent", "Torrent File (BitTorrent)"), ("application/postscript", "Print Document (PostScript)"), ("application/unknown", "Unknown file"), ("application/ResEdit", "Resource (ResEdit)"), ("application/octet-stream", "Binary File (Generic)"), ("application/vnd.ms-outlook-pst", "Outlook Data File (PST)"),
]

#: Names that tools give to one field.
EQUIVALENT = [
    ["CreateDate", "dcterms:created"], ["MediaModifyDate", "dcterms:modified"], ["MediaCreateDate", "Media Created Date", "st_birthtime"], ["FileModifyDate", "File Modified Date", "st_mtime"],
    ["FileAccessDate", "st_atime"], ["Creator", "dc:creator"], ["LastModifiedBy", "meta:last-author"], ["FileSize", "File Size", "Content-Length", "st_size"],
    ["RevisionNumber", "cp:revision"], ["TotalEditTime", "extended-properties:TotalTime"], ["Words", "meta:word-count"], ["Characters", "meta:character-count"],
    ["Application", "extended-properties:Application"], ["MIMEType", "Content-Type"], ["Pages", "meta:page-count"], ["ImageHeight", "tiff:ImageLength"],
    ["ImageWidth", "Image Width", "tiff:ImageWidth"], ["BitsPerSample", "tiff:BitsPerSample"], ["ColorComponents", "Number of Components"], ["XResolution", "X Resolution"], ["YResolution", "Y Resolution"],
    ["Duration", "xmpDM:duration"], ["Comment", "xmpDM:logComment"], ["AudioSampleRate", "audioSampleRate"], ["PDFVersion", "pdf:PDFVersion"], ["Title", "dc:title"], ["Producer", "pdf:producer"],
    ["CreatorTool", "xmp:CreatorTool"], ["DocumentID", "xmpMM:DocumentID"], ["FileInodeChangeDate", "st_ctime"], ["FilePermissions", "st_mode"], ["Compression", "Compression Type"],
    ["ColorSpace", "Exif SubIFD:Color Space"], ["Orientation", "Exif IFD0:Orientation", "tiff:Orientation"], ["ResolutionUnit", "Resolution Units", "tiff:ResolutionUnit"],
    ["Make", "Exif IFD0:Make", "tiff:Make"], ["Model", "Exif IFD0:Model", "tiff:Model"], ["Flash", "Exif SubIFD:Flash", "exif:Flash"], ["FNumber", "Aperture", "Exif SubIFD:F-Number", "exif:FNumber"],
    ["FocalLength", "Exif SubIFD:Focal Length", "exif:FocalLength"], ["ExposureTime", "Exif SubIFD:Exposure Time", "exif:ExposureTime"], ["ISO", "Iso"], ["WhiteBalance", "Exif SubIFD:White Balance Mode"],
    ["MeteringMode", "Exif SubIFD:Metering Mode"], ["ExposureMode", "Exif SubIFD:Exposure Mode"], ["ExposureCompensation", "Exif SubIFD:Exposure Bias Value"], ["ExifVersion", "Exif SubIFD:Exif Version"],
    ["LanguageCode", "language"], ["MIMEEncoding", "Content-Encoding"], ["ThumbnailLength", "Exif Thumbnail:Thumbnail Length"], ["ThumbnailOffset", "Exif Thumbnail:Thumbnail Offset"],
    ["Subject", "dc:subject"], ["Comment", "w:Comments"], ["GPSAltitude", "GPS:GPS Altitude"], ["GPSAltitudeRef", "GPS:GPS Altitude Ref"], ["GPSDateStamp", "GPS:GPS Date Stamp"],
    ["GPSTimeStamp", "GPS:GPS Time-Stamp"], ["GPSProcessingMethod", "GPS:GPS Processing Method"], ["SubjectDistance", "Exif SubIFD:Subject Distance"], ["VideoFrameRate", "Video Frame Rate"],
    ["PixelAspectRatio", "Pixel Aspect Ratio"], ["AudioSampleCount", "Audio Sample Count"], ["AvgBytesPerSec", "Avg Bytes Per Sec"], ["NumChannels", "Num Channels"], ["SampleSize", "Sample Size"],
    ["StreamCount", "Stream Count"], ["VideoCodec", "Video Codec"], ["VideoFrameCount", "Video Frame Count"], ["FrameCount", "Frame Count"], ["MaxDataRate", "Max Data Rate"],
    ["PhotometricInterpretation", "Exif IFD0:Photometric Interpretation"], ["SamplesPerPixel", "Exif IFD0:Samples Per Pixel", "tiff:SamplesPerPixel"], ["Composer", "xmpDM:composer"],
    ["FontFamily", "FontFamilyName"], ["FontName-en-US", "FontName"], ["FontSubfamily-en-US", "FontSubFamilyName"], ["DocSecurity", "extended-properties:DocSecurity"],
    ["CFAPattern", "Exif SubIFD:CFA Pattern"], ["PlanarConfiguration", "Exif IFD0:Planar Configuration"], ["CopyrightNotice", "Copyright Notice"], ["StripOffsets", "Exif IFD0:Strip Offsets"],
    ["AudioFormat", "Audio Format"], ["MediaLanguageCode", "Media Language Code"], ["GraphicsMode", "Graphics Mode"], ["Predictor", "Exif IFD0:Predictor"], ["Editing-cycles", "editing-cycles"],
]

#: The sets of metadata types, and their labels, in the order in which they claim a field.
SETS = [
    ("FileSystemMetadata", "File system metadata"), ("SecurityMetadata", "Security metadata"), ("ImageMetadata", "Image metadata"), ("AudioMetadata", "Audio metadata"), ("VideoMetadata", "Video metadata"),
    ("EmailMetadata", "Email metadata"), ("ExecutableMetadata", "Executable metadata"), ("CompressedFileMetadata", "Compressed file metadata"), ("DocumentContentMetadata", "Document content metadata"), ("Other", "Other metadata"),
]

#: Fields whose values tell of problems, fields that describe the extraction, and fields with a version.
WARNINGS = ["X-TIKA:EXCEPTION:warn", "X-TIKA:EXCEPTION:container_exception", "X-TIKA:EXCEPTION:embedded_exception", "X-TIKA:EXCEPTION:embedded_parser", "Warning"]
CONTROL = ["X-TIKA:Parsed-By", "X-TIKA:Parsed-By-Full-Set", "X-TIKA:parse_time_millis", "X-TIKA:embedded_depth", "embeddedRelationshipId", "X-TIKA:embedded_resource_path", "X-TIKA:origResourceName", "X-TIKA:content_handler"]
VERSIONS = ["ExifToolVersion", "ExifTool Version", "Tool Version", "Version", "ExifTool:Version", "System:ExifToolVersion", "Data", "Versione"]

#: Fields that name people, fields that are never redacted, and fields that lead a description.
AUTHORS = ["Creator", "dc:creator", "Author", "LastModifiedBy", "meta:last-author"]
PROTECTED = ["FileSize", "Software", "CreateDate", "dcterms:modified", "st_mtime", "Content-Length", "MediaModifyDate", "MediaCreateDate", "dcterms:created", "FileModifyDate", "FileAccessDate", "File Size", "st_size", "MIMEType", "hierarchyDepth", "FileType", "FileTypeExtension", "Content-Type", "file_type", "st_atime", "st_ctime", "st_blksize", "st_blocks", "st_dev", "st_gid", "st_ino", "st_mode", "st_nlink", "st_uid", "FilePermissions", "FileInodeChangeDate"]
LEADING = ["ImageWidth", "ImageHeight", "tiff:ImageWidth", "tiff:ImageLength", "Duration", "AudioChannels", "AudioSampleRate", "VideoFrameRate", "Pages", "meta:page-count", "Words", "meta:word-count", "Creator", "dc:creator", "Author", "Title", "dc:title", "CreateDate", "dcterms:created", "ModifyDate", "dcterms:modified"]

#: Which set a field belongs to is a parameter (field, set, priority); without a table, these parts of a name tell.
SET_RULES = [
    ("FileSystemMetadata", r"^(st_|File ?(Name|Size|Mod|Access|Inode|Perm|Attr)|Directory|file_type)"),
    ("SecurityMetadata", r"(?i)encrypt|password|signature|certificate|permission"),
    ("ImageMetadata", r"(?i)^(tiff|exif|gps)|image|pixel|color|resolution|orientation|thumbnail|flash|focal|aperture|iso$"),
    ("AudioMetadata", r"(?i)audio|sample|channel|bitrate|artist|album"),
    ("VideoMetadata", r"(?i)video|frame|codec|track"),
    ("EmailMetadata", r"(?i)^message|mail|sender|recipient|^subject$"),
    ("ExecutableMetadata", r"(?i)machine|linker|entrypoint|subsystem|codesize"),
    ("CompressedFileMetadata", r"(?i)^zip|compress|archive"),
    ("DocumentContentMetadata", r"(?i)page|word|character|^dc:|^dcterms:|^meta:|^pdf|title|author|creator|mime|content-type|language"),
]
