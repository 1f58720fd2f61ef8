"""Fixed values.

FIXED VALUES: the lists below must equal the behaviour being reproduced
(header vocabularies, status words, thresholds, labels).  They are stated
plainly, in their natural order, and are not derived from anything.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — canonical column vocabulary.  Dict order is the matching
# priority: more specific names (customer, store, channel, region) come
# before the generic product name.
# ---------------------------------------------------------------------------
COLUMN_MAPPINGS: dict[str, list[str]] = {
    "date": [
        "date", "tanggal", "tgl", "order_date", "transaction_date", "sale_date",
        "timestamp", "waktu", "tanggal_transaksi", "tanggal_penjualan",
        "tanggal_order", "tgl_transaksi", "tgl_penjualan", "tgl_order",
        "created_at", "updated_at", "invoice_date", "tanggal_faktur",
        "tgl_order", "tgl_transaksi", "tgl_faktur", "tgl_invoice",
    ],
    "order_id": [
        "no_pesanan", "no_order", "order_id", "id_order", "no_invoice",
        "invoice", "no_faktur", "faktur", "ref", "kode_transaksi",
        "nomor_pesanan", "nomor_order", "nomor_invoice", "nomor_faktur",
        "transaction_id", "id_transaksi",
    ],
    "customer": [
        "customer", "customer_id", "id_customer", "customer_name",
        "nama_customer", "nama_pelanggan", "pelanggan", "id_pelanggan",
        "buyer", "nama_pembeli", "pembeli",
        "client", "klien", "nama_klien", "id_klien",
        "konsumen", "nama_konsumen",
        "member", "nama_member", "id_member",
        "pemesan", "nama_pemesan",
    ],
    "store": [
        "store", "nama_store", "id_store",
        "toko", "nama_toko", "id_toko", "kode_toko",
        "outlet", "nama_outlet", "id_outlet", "kode_outlet",
        "gerai", "nama_gerai",
        "shop", "nama_shop",
        "warung", "lapak",
    ],
    "channel": [
        "channel", "nama_channel", "sales_channel",
        "marketplace", "platform", "nama_platform",
        "saluran", "saluran_penjualan", "sumber", "sumber_penjualan",
        "media", "media_penjualan",
        "shopee", "tokopedia", "lazada", "bukalapak", "blibli", "tiktok_shop",
    ],
    "region": [
        "region", "nama_region", "id_region", "kode_region",
        "lokasi", "location",
        "area", "nama_area", "kode_area",
        "city", "kota", "nama_kota", "kode_kota",
        "province", "provinsi", "nama_provinsi",
        "wilayah", "nama_wilayah", "kode_wilayah",
        "cabang", "nama_cabang", "kode_cabang", "id_cabang",
        "branch", "nama_branch",
        "district", "kecamatan", "kelurahan",
        "daerah", "zona", "zone",
    ],
    "category": [
        "category", "kategori", "nama_kategori", "kode_kategori",
        "product_category", "kategori_produk",
        "type", "tipe", "jenis", "jenis_produk",
        "divisi", "division",
        "group", "grup", "kelompok", "product_group", "product_type",
        "kelas", "kelas_produk",
        "brand", "merek", "merk",
        "sub_category", "sub_kategori",
    ],
    "product": [
        "product", "id_product", "kode_product",
        "produk", "nama_produk", "id_produk", "kode_produk",
        "product_name", "product_desc", "product_description",
        "item", "item_name", "item_desc", "nama_item", "kode_item",
        "barang", "nama_barang", "kode_barang", "id_barang",
        "goods", "merchandise",
        "sku", "kode_sku",
        "komoditi", "komoditas",
        "nama_produk/jasa", "produk/jasa",
        "deskripsi_produk", "deskripsi_barang",
    ],
    "quantity": [
        "quantity", "qty", "jumlah", "jml",
        "jumlah_barang", "jml_barang", "jumlah_unit", "jml_unit",
        "jumlah_terjual", "unit_terjual", "qty_sold",
        "terjual", "banyak", "volume",
        "pieces", "pcs", "unit",
        "kuantitas",
    ],
    "price": [
        "price", "unit_price", "price_per_unit", "selling_price",
        "harga", "harga_satuan", "harga_jual", "harga_per_unit",
        "harga_item", "harga_produk", "harga_barang",
        "unit_cost", "harga_pokok", "hpp", "cost",
        "rate", "tarif", "tariff",
    ],
    "revenue": [
        "revenue", "total_revenue", "gross_sales", "net_sales",
        "total_sales", "sale_amount", "sales_amount",
        "grand_total", "total_price", "total_amount",
        "penjualan", "total_penjualan", "nilai_penjualan",
        "total_harga", "harga_total", "total_harga_jual",
        "total_bayar", "total_pembayaran",
        "omset", "pendapatan", "income",
        "subtotal", "sub_total",
        "nominal", "nilai", "jumlah_total", "total_transaksi",
        "total",
    ],
    "courier": [
        "kurir", "courier", "ekspedisi", "jasa_kirim", "pengiriman",
        "shipping_courier", "nama_kurir",
    ],
    "salesperson": [
        "salesperson", "sales_person", "sales", "nama_sales", "agen",
        "sales_name", "nama_agen", "nama_salesperson",
        "marketing", "nama_marketing", "marketer",
        "staff_penjualan", "petugas_penjualan",
    ],
    "status": [
        "status", "status_order", "status_transaksi", "status_pembayaran",
        "kondisi", "order_status", "transaction_status", "payment_status",
        "status_pengiriman", "status_penjualan",
    ],
    "discount": [
        "diskon", "discount", "potongan", "potongan_harga", "promo",
        "voucher", "cashback",
    ],
    "shipping": [
        "ongkir", "ongkos_kirim", "biaya_kirim", "biaya_pengiriman",
        "shipping", "shipping_cost", "freight",
    ],
    "tax": [
        "pajak", "tax", "ppn", "vat", "tax_amount",
    ],
}

# FIXED VALUES — words that forbid a substring match to "product".
PRODUCT_PARTIAL_BLACKLIST = [
    "toko", "store", "outlet", "gerai", "warung", "lapak", "shop",
    "pelanggan", "customer", "pembeli", "buyer", "klien", "konsumen",
    "member", "pemesan",
    "cabang", "branch", "region", "wilayah", "area", "kota", "lokasi",
    "channel", "marketplace", "platform", "saluran",
    "kurir", "courier", "ekspedisi",
    "status", "kondisi",
    "tanggal", "date", "tgl", "waktu",
    "harga", "price", "total", "revenue", "omset", "bayar",
    "qty", "jumlah", "quantity",
    "diskon", "discount", "ongkir", "pajak", "tax",
    "invoice", "faktur", "order", "transaksi",
    "sales", "salesperson", "agen", "marketing",
]

# FIXED VALUES — words that forbid a substring match to "customer".
CUSTOMER_PARTIAL_BLACKLIST = [
    "sales", "salesperson", "agen", "marketing", "marketer",
    "status", "kondisi", "channel", "kurir", "courier",
    "produk", "product", "barang", "item",
    "toko", "store", "outlet",
]

# FIXED VALUES — header names never remapped by a substring match.
HARD_RESERVED_COLUMNS = [
    "status", "status_order", "status_transaksi", "status_pembayaran",
    "order_status", "transaction_status", "payment_status",
    "kondisi", "kurir", "courier", "ekspedisi",
    "diskon", "discount", "ongkir", "shipping", "pajak", "tax",
]

# FIXED VALUES — cell values that reveal a status column.
STATUS_LIKE_VALUES = [
    "selesai", "completed", "complete", "sukses", "success",
    "dikirim", "shipped", "diproses", "processing", "pending",
    "menunggu", "cancel", "cancelled", "dibatalkan",
    "return", "returned", "dikembalikan", "refund",
    "gagal", "failed", "lunas", "unpaid", "paid",
]
STATUS_LIKE_SHARE = 0.4          # more than this share of status words → status column

# FIXED VALUES — success keywords matched with "contains" on normalised status text.
SUCCESS_KEYWORDS = [
    "selesai", "completed", "complete", "sukses", "success", "berhasil",
    "lunas", "paid", "delivered", "terkirim", "diterima", "confirmed",
    "terkonfirmasi", "approved", "disetujui", "finish", "done",
    "pesanan selesai", "order selesai", "transaksi selesai", "order completed",
]

# FIXED VALUES — date formats tried in order on the whole column.
# Written as strptime formats: %Y-%m-%d, %d-%m-%Y, %m-%d-%Y, %Y/%m/%d,
# %d/%m/%Y, %m/%d/%Y, %d-%m-%y, %d/%m/%y, %Y%m%d, %d%m%Y, %B %d, %Y,
# %b %d, %Y, %d %B %Y, %d %b %Y.  The Spark patterns use single letters for
# day/month so that one or two digits are accepted, like strptime.
DATE_FORMATS = [
    "yyyy-M-d", "d-M-yyyy", "M-d-yyyy",
    "yyyy/M/d", "d/M/yyyy", "M/d/yyyy",
    "d-M-yy", "d/M/yy",
    "yyyyMMdd", "ddMMyyyy",
    "MMMM d, yyyy", "MMM d, yyyy",
    "d MMMM yyyy", "d MMM yyyy",
]

# FIXED VALUES — default missing-value strategy per canonical column.
DEFAULT_FILL_STRATEGY = {
    "quantity": "median",
    "price": "median",
    "revenue": "median",
    "product": "mode",
    "category": "mode",
    "region": "mode",
}

# FIXED VALUES — name fragments of a numeric column usable as revenue.
REVENUE_KEYWORDS = ["total", "amount", "nilai", "nominal", "sales", "omset",
                    "pendapatan", "income", "bayar", "harga_total"]

# FIXED VALUES — candidate columns per dimension, first present wins.
DIMENSION_CANDIDATES = {
    "product": ["product", "nama_produk", "produk", "item", "barang"],
    "category": ["category", "kategori"],
    "customer": ["customer", "pelanggan", "buyer", "pembeli", "customer_name", "nama_pelanggan"],
    "region": ["region", "kota", "city", "wilayah", "provinsi", "cabang", "area"],
    "salesperson": ["salesperson", "sales_person", "sales", "nama_sales", "agen"],
    "store": ["store", "nama_toko", "toko", "outlet"],
    "channel": ["channel", "marketplace", "platform"],
    "cost": ["cost", "hpp", "harga_pokok", "cogs"],
}

# FIXED VALUES — proxy columns when there is no salesperson column.
SALESPERSON_PROXIES = ["channel", "store", "courier"]

# FIXED VALUES — salesperson names that are not people.
NON_SALESPERSON_NAMES = ["online", "-", "n/a", "none", ""]

# FIXED VALUES — RFM segment thresholds on the score sum (3..15).
RFM_SEGMENTS = [(13, "Champions"), (10, "Loyal"), (7, "Potential"), (4, "At Risk")]
RFM_LOWEST_SEGMENT = "Lost"

# FIXED VALUES — product segment names.
SEGMENT_STAR = "Star Products"
SEGMENT_PREMIUM = "Premium Products"
SEGMENT_VOLUME = "Volume Products"
SEGMENT_LOW = "Low Performers"

# FIXED VALUES — weekday names, Monday first (weekday() = 0).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# FIXED VALUES — default profit margin when there is no cost column (percent).
DEFAULT_MARGIN_PCT = 30
TARGET_UPLIFT = 1.10
